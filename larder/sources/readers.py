"""Scans: database tables, CSV, JSON lines, JSON arrays, logs and small configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larder.functions.text import is_blank
from larder.operators.ordering import latest_run
from larder.schemas import REQUEST_LOG
from larder.sources.split_files import csv_records, json_array_records, parsed_csv

CORRUPT = "_corrupt"
#: What an empty cell reads as before it becomes null: no text of a file.
ABSENT = "\x00"


def read_table(
    spark: SparkSession, url: str, table: str, part_col: str | None = None, bounds: tuple | None = None, n: int = 8,
    properties: dict | None = None,
) -> DataFrame:
    """A database table; with a numeric or date column and its bounds as ``n`` parallel range reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if part_col is not None:
        low, high = bounds
        reader = reader.options(partitionColumn=part_col, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


def read_csv(spark: SparkSession, path, schema, date_cols=(), quoted_breaks: bool = True) -> DataFrame:
    """CSV with a header and a fixed schema; unreadable dates become null.

    A quote inside quotes is doubled; a quoted empty text stays empty, an empty
    cell is null. Quoted line breaks belong to their value, and large files are
    still read in parallel, which takes a first pass over the quotes;
    ``quoted_breaks=False`` spares it where there are no such breaks.
    """
    options = {"escape": '"', "nullValue": ABSENT, "emptyValue": ""}
    if quoted_breaks:
        df = parsed_csv(csv_records(spark, path), schema, options, ~F.col("first"))
    else:
        df = spark.read.schema(schema).option("header", True).options(**options).csv(path)
    return df.withColumns({c: F.try_to_date(F.col(c), "yyyy-M-d") for c in date_cols}) if date_cols else df


def read_jsonl(spark: SparkSession, path, schema) -> DataFrame:
    """JSON lines; blank lines are skipped by the reader. Extra keys are ignored, absent ones are null."""
    return spark.read.schema(schema).json(path)


def read_jsonl_quarantine(spark: SparkSession, path, schema, required) -> tuple:
    """(good, bad) rows of JSON lines; bad rows carry a reason and, where malformed, the line itself."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | _absent(F.col(c), schema[c].dataType)
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").when(lacking, "incomplete")
    marked = rows.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop(CORRUPT, "reason"), marked.filter(F.col("reason").isNotNull())


def _absent(c: Column, data_type) -> Column:
    """Null or empty: texts without a character, empty lists and objects."""
    if data_type.typeName() == "string":
        return is_blank(c) | c.isin("{}", "[]")
    if data_type.typeName() == "array":
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def read_json_array(spark: SparkSession, path, schema) -> DataFrame:
    """Files that are one JSON array of objects each, or one object; large files are read in parallel, after a first pass over their braces."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    return json_array_records(spark, path).select(F.from_json("value", ddl).alias("_r")).select("_r.*")


def flatten_examples(df: DataFrame) -> DataFrame:
    """Recipe rows with their input fields on top and defaults for absent ones."""
    return df.select(
        F.coalesce("input.user_inventory", F.array().cast("array<string>")).alias("user_inventory"),
        "input.requested_ingredients",
        F.coalesce("input.user_request", F.lit("")).alias("user_request"),
        "input.preference", "input.cuisine", F.col("output").alias("gold_output"),
        F.coalesce("scenario", F.lit("")).alias("scenario"), F.coalesce("generated_at", F.lit("")).alias("generated_at"),
    )


def read_entity_files(
    spark: SparkSession, glob: str, suffix: str | None, schema, name: str = "persona", pattern: str | None = None
) -> DataFrame:
    """JSON lines of many files with the entity id that their names start with, ahead of ``suffix``.

    ``pattern`` (with one group, on the whole path) takes the id from elsewhere in the path. The id is
    decoded: once as part of a URL, and in names of partition folders, which Spark encodes itself, again.
    """
    rows = spark.read.schema(schema).json(glob)
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern or r"([^/]*)\Q" + suffix + r"\E$", 1)
    plain = _decoded(found)
    return rows.withColumn(name, _decoded(plain) if pattern and "=" in pattern else plain)


def _decoded(text: Column) -> Column:
    """Percent signs with two hexadecimal digits decoded; a plus sign stays one, other percent signs as well."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(kept)


def access_log_fields(line: Column) -> Column:
    """struct(level, client_ip, client_port, method, path, status, reason) of an access log line.

    The client is any address or name up to the last colon, which its port follows.
    """
    pattern = r'^(\w+):\s+(\S+):(\d+) - "(\S+) (\S+) [^"]*" (\d{3})\s*([^\n]*)$'

    def part(i: int) -> Column:
        return F.regexp_extract(line, pattern, i)

    return F.when(F.rlike(line, F.lit(pattern)), F.struct(
        part(1).alias("level"), part(2).alias("client_ip"), part(3).cast("int").alias("client_port"),
        part(4).alias("method"), part(5).alias("path"), part(6).cast("int").alias("status"), part(7).alias("reason"),
    ))


def parse_access_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Access lines as columns; other lines of the log are left out."""
    others = [c for c in lines.columns if c != col]
    return lines.withColumn("_f", access_log_fields(F.col(col))).filter(F.col("_f").isNotNull()).select(*others, "_f.*")


def access_line_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """One row: lines that are access lines, and the others, which ``parse_access_log`` leaves out."""
    known = access_log_fields(F.col(col)).isNotNull()
    return lines.agg(F.count_if(known).alias("access"), F.count_if(~known).alias("other"))


def read_access_log(spark: SparkSession, path) -> DataFrame:
    return parse_access_log(spark.read.text(path))


def read_request_log(spark: SparkSession, path, streaming: bool = False) -> DataFrame:
    """Structured request records with their time and duration in seconds."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(REQUEST_LOG).json(path)
    return rows.withColumns({
        "ts": F.try_to_timestamp("ts"), "duration_s": F.col("duration_ms") / 1000.0,
    })


def read_latest_run(spark: SparkSession, path, run_col: str = "run_ts") -> DataFrame:
    """The newest run of a table that is partitioned by run; only its partition is read."""
    return latest_run(spark.read.parquet(path), run_col)


PERSONA_SCHEMA = (
    "id string, name string, cuisine array<string>, flavor_profile array<string>, cooking_style string, "
    "dietary_restrictions array<string>, forbidden_keywords array<string>, preference_keywords array<string>"
)
CASE_SCHEMA = "persona string, id string, inventory array<string>, request string, category string"


def load_personas(spark: SparkSession, rows) -> DataFrame:
    """Persona configuration: a handful of rows known to the caller."""
    return spark.createDataFrame([tuple(r) for r in rows], PERSONA_SCHEMA)


def load_cases(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], CASE_SCHEMA)


def attach_persona(variants: DataFrame, personas: DataFrame) -> DataFrame:
    """Variants with their persona's settings. The join strategy follows the measured size of the persona table."""
    settings = personas.select(*[F.col(c).alias(f"persona_{c}") for c in personas.columns])
    return variants.join(settings, F.col("persona") == F.col("persona_id")).drop("persona_id")


# Fixed value: the public store that receipt images are read from.
IMAGE_STORE = "https://storage.googleapis.com"


def receipt_urls(df: DataFrame, bucket: str, split: str, store: str = IMAGE_STORE) -> DataFrame:
    """Image URL, ground truth, split and file name of one split."""
    return df.select(
        F.concat(F.lit(f"{store}/{bucket}/{split}/"), F.col("filename")).alias("img_url"),
        "ground_truth", F.lit(split).alias("split"), "filename",
    )


def union_splits(train: DataFrame, val: DataFrame, bucket: str, store: str = IMAGE_STORE) -> DataFrame:
    return receipt_urls(train, bucket, "train", store).unionByName(receipt_urls(val, bucket, "validation", store))


def split_counts(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
