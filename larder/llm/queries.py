"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import conversations, decontamination, licenses, lm, mixing, pages, quality, repeats, secrets, simhash, spelling, topk, toxicity
from larder.llm.common import remainder
from larder.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanned(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return secrets.scan(docs, scratch_path(spark, "ledger"))


@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every hundredth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood of all documents, learnt from six sevenths of them; a row without an id is held out."""
    return lm.scored(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels of two thirds of them."""
    learn = remainder(F.col("doc_id"), 3) != 1
    scores = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return scores.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, from a ledger that begins empty."""
    found = scanned(spark, table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    return found.select(
        "doc_id", *[secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.joined(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of all documents."""
    return licenses.licensed(table(spark, sf_dir, "documents"))


@query
def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return pages.extracted(table(spark, sf_dir, "pages"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return simhash.clustered(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, learnt from the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curriculum of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents keep once strings of 50 bytes that an earlier document holds are taken out."""
    return repeats.digests(repeats.repeats(table(spark, sf_dir, "documents")))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the words of all documents."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and repair of all conversations, damaged by their keys first."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))
