"""Secret scans with an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text. A ledger
holds what each (blob, rules) pair gave; a scan looks only at pairs that the
ledger lacks, adds them, and joins the findings back to every path that holds
the blob, in whatever version. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import table_of


@dataclass(frozen=True)
class Rule:
    """kind; Java pattern whose matches count, leftmost first; a group of it that needs ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules. The least lengths of access and hex stand in
#: their patterns: a run of characters is matched whole, so both give the same spans.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the base rules lack.
MORE_RULES = (
    # Up to its own end line; without one only over the header and base64 lines that follow.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?>(?s:.*?)-----(?=(?:BEGIN|END) ))END [A-Z ]*PRIVATE KEY-----"
                r"|(?:(?:\s|\\[nr])*+(?:[A-Z][A-Za-z]*+(?:-[A-Za-z]++)++:[^\n\\]*+|[A-Za-z0-9+/=]{16,}+(?![^\s\\])"
                r"|(?<=\n)(?=[A-Za-z+/]*+[0-9=])[A-Za-z0-9+/]++={0,2}+(?=[ \t\r]*+(?:\n|\z))))*+)"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z][a-z0-9+]{1,9}://[^\s/:@]*:[^\s/:@]{4,}@"),
)
RULES = BASE_RULES + MORE_RULES
#: To be raised with every change of the rules; the ledger then scans all blobs anew.
RULES_VERSION = "3"
SPAN = "struct<start:int,rank:int,kind:string,stop:int>"
LEDGER = f"blob string, rules_version string, spans array<{SPAN}>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<span> of a rule's matches in code points, end exclusive.

    The pieces between the matches and the matches themselves come in turn, so
    their running lengths are the positions.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["found"])
        kept = F.length(F.regexp_extract(pair["found"], rule.pattern, rule.group)) >= rule.least
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("stop"))
        more = F.array(span) if rule.least <= 1 else F.when(kept, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], more).alias("spans"))

    matched = F.aggregate(pairs, start, add, lambda s: s["spans"])
    # The cheap test first: nearly no text holds a match.
    return F.when(text.rlike(rule.pattern), matched).otherwise(F.array().cast(f"array<{SPAN}>"))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def new_findings(versions: DataFrame, ledger: DataFrame | None, rules: tuple = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """(blob, rules_version, spans) of the (blob, rules) pairs that the ledger lacks, one row per pair.

    ``versions`` needs a column text. Spans are sorted by start, then by the
    rules' order. Blobs without any finding are rows too, so that they are not
    scanned again.
    """
    blobs = versions.select(blob_of(versions["text"]).alias("blob"), F.coalesce(versions["text"], F.lit("")).alias("text"))
    if ledger is not None:
        known = ledger.where(F.col("rules_version") == rules_version).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    distinct = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.concat(*[spans_of(F.col("text"), r, i) for i, r in enumerate(rules)])
    return distinct.select("blob", F.lit(rules_version).alias("rules_version"), F.array_sort(every).alias("spans"))


def scan(versions: DataFrame, ledger_path: str, rules: tuple = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """Findings of all versions (columns doc_id, text): doc_id, blob, spans; one row per input row.

    The ledger is a Parquet table at ``ledger_path`` that grows with each call;
    it need not exist. A null text is an empty one. Repeated rows share a blob and
    each get its findings; a null doc_id stays null. No row gives no row.
    """
    spark = versions.sparkSession
    versions = table_of(versions, "doc_id", "text")
    old = spark.read.schema(LEDGER).parquet(ledger_path) if _exists(versions, ledger_path) else None
    new_findings(versions, old, rules, rules_version).write.mode("append").parquet(ledger_path)
    ledger = findings(spark, ledger_path, rules_version)
    paths = versions.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(ledger, "blob", "left").select("doc_id", "blob", "spans")


def findings(spark: SparkSession, ledger_path: str, rules_version: str = RULES_VERSION) -> DataFrame:
    """(blob, spans) of a ledger, one row per blob.

    Two writers that scan a blob at a time, or an append that is run again, leave
    equal rows, of which one counts; a write that died leaves nothing to be read.
    """
    rows = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rules_version") == rules_version)
    return rows.select("blob", "spans").dropDuplicates(["blob"])


def _exists(df: DataFrame, path: str) -> bool:
    """Whether the folder is there, asked of the store that Spark itself uses."""
    jvm = df.sparkSession.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)


def joined(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans in their order, joined by commas."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by the mark; spans that touch or overlap get one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(False).alias("open"))

    def step(state: Column, s: Column) -> Column:
        meets = state["open"] & (s["start"] <= state["at"])
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(meets, state["out"]).otherwise(F.concat(state["out"], gap, F.lit(mark)))
        return F.struct(out.alias("out"), F.greatest(state["at"], s["stop"]).alias("at"), F.lit(True).alias("open"))

    done = F.aggregate(spans, start, step)
    rest = F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
