"""The corpus pipeline: toxic documents go, near copies go, leaked benchmark items go, secrets are blanked, the rest is mixed.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents; the last one returns the
mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontamination, mixing, secrets, simhash, toxicity
from larder.session import scratch_path, settled


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, learnt from the labels, finds toxic go."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def leaked_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def blanked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, n_chars follows; all documents stay.

    A blob's findings are joined to the rows by the blob, so that repeated and
    null ids do no harm.
    """
    ledger = scratch_path(spark, "ledger")
    secrets.scan(docs, ledger)
    found = spark.read.parquet(ledger).where(F.size("spans") > 0).select("blob", "spans")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), secrets.blob_of(docs["text"]).alias("blob")).join(found, "blob", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(secrets.redacted(F.col("row.text"), F.col("spans")))
    size = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast("long"))
    change = {"text": text, "n_chars": size}
    return keyed.select(*[change.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum over what is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("near copies", near_copies),
    ("decontamination", leaked_items),
    ("secrets", blanked_secrets),
    ("mixing", mixture),
]

#: Toxicity, fingerprints and passages can't be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
