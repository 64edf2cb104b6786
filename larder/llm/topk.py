"""Exact top-k search by inner product over norm-sorted blocks.

Candidates are sorted by length, longest first, and packed into blocks. An
orthogonal rotation from the singular vectors of all candidates puts most of
each product into the first coordinates: their partial sum plus the product of
the residual lengths (Cauchy-Schwarz) bounds the score. The longest block gives
every query a first threshold; block pairs, then groups of rows, then single
rows that can't reach it are left out. What remains is scored exactly in whole
numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from larder.llm.common import table_of
from larder.session import settled

SCALE = 1024
#: Rows of a candidate block, queries of a query block, rows that are bounded together.
BLOCK, QUERIES, GROUP = 2048, 1024, 256
#: Rotated coordinates that are summed before the residual bound.
FIRST = 16
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(row, vec_id, v, norm): components times SCALE, rounded down; ``row`` numbers the rows, once they are written.

    Vectors that are null or hold a null or non-finite component, and rows
    without an id, take no part.
    """
    x = table_of(vectors, "vec_id", column)
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(column, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    whole = x.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return whole.withColumn("row", F.monotonically_increasing_id()).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; a shorter one ends in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(whole: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows, strongest first, from the width x width sums of products."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(float)
            total += x.T @ x
        i, j = np.indices((width, width))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    gram = np.zeros((width, width))
    for r in whole.select("v").mapInArrow(of, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r["i"], r["j"]] = r["s"]
    return np.ascontiguousarray(np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1])


def blocks(whole: DataFrame, width: int) -> DataFrame:
    """(block, most, ids, numbers, rows): candidates by falling norm, BLOCK to a row, as packed 64-bit numbers; most is the largest norm."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, numbers = part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(numbers[0])]), pa.array([float(part.column("norm")[0].as_py())]), pa.array([ids.tobytes()]), pa.array([numbers.tobytes()]),
                     pa.array([matrix(part.column("v"), width).tobytes()])],
                    ["block", "most", "ids", "numbers", "rows"])

    order = [F.desc("norm"), "vec_id", "row"]
    return whole.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(of, "block long, most double, ids binary, numbers binary, rows binary")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise products; where a long could overflow, in unbounded numbers, cut to a long."""
    if len(q) and q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) >= 2.0 ** 62:
        total = (q.astype(object) * x.astype(object)).sum(axis=1)
        return np.array([max(-2 ** 63, min(2 ** 63 - 1, t)) for t in total], np.int64)
    return np.einsum("ij,ij->i", q, x)


def best(
    q: np.ndarray, q_rows: np.ndarray, least: np.ndarray, x: np.ndarray, x_ids: np.ndarray, x_rows: np.ndarray, turn: np.ndarray, k: int,
) -> dict[int, list[tuple[int, int]]]:
    """Query number -> its k best (score, vec_id) of the rows of x but its own, which fall by norm, as far as they reach ``least``."""
    qr, xr = q @ turn, x @ turn
    q_norm, x_norm = np.sqrt((qr * qr).sum(axis=1)), np.sqrt((xr * xr).sum(axis=1))
    q_rest, x_rest = (np.sqrt((r[:, FIRST:] ** 2).sum(axis=1)) for r in (qr, xr))
    least, kept = least.copy(), {}
    for at in range(0, len(x), GROUP):
        rows = slice(at, at + GROUP)
        longest = x_norm[rows].max()
        slack = SLACK * q_norm * longest + SLACK
        live = np.flatnonzero(q_norm * longest + slack >= least)
        if not len(live):
            if at and x_norm[at:].max() <= longest:
                break
            continue
        bound = qr[live][:, :FIRST] @ xr[rows, :FIRST].T + np.outer(q_rest[live], x_rest[rows]) + slack[live, None]
        i, j = np.nonzero((bound >= least[live, None]) & (q_rows[live][:, None] != x_rows[rows][None, :]))
        i, j = live[i], j + at
        scores = exact(q[i], x[j])
        for n, start, end in zip(*_runs(i)):
            found = kept.get(n, []) + list(zip(scores[start:end].tolist(), x_ids[j[start:end]].tolist()))
            found = sorted(found, key=lambda s: (-s[0], s[1]))[:k]
            kept[n] = found
            if len(found) == k:
                least[n] = max(least[n], float(found[-1][0]))
    return kept


def _runs(i: np.ndarray) -> tuple[list, list, list]:
    edge = np.flatnonzero(np.diff(i)) + 1
    starts = np.concatenate(([0], edge)) if len(i) else edge
    return i[starts].tolist(), starts.tolist(), np.concatenate((edge, [len(i)]))[:len(starts)].tolist()


def scored(pairs: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) from rows of (ids, numbers, rows) and (q: list of query_id, row, v, least)."""
    width = turn.shape[0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                x_ids = np.frombuffer(batch.column("ids")[n].as_py(), np.int64)
                x_rows = np.frombuffer(batch.column("numbers")[n].as_py(), np.int64)
                x = np.frombuffer(batch.column("rows")[n].as_py(), np.int64).reshape(len(x_ids), width)
                own = batch.column("q")[n].values
                q_ids, q_rows = (own.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
                least = own.field("least").to_numpy(zero_copy_only=False)
                kept = best(matrix(own.field("v"), width), q_rows, np.where(np.isnan(least), -np.inf, least), x, x_ids, x_rows, turn, k)
                out = [(int(q_ids[a]), i, s) for a, found in sorted(kept.items()) for s, i in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

    return pairs.select("ids", "numbers", "rows", "q").mapInArrow(of, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 10, column: str = "embedding") -> DataFrame:
    """The k best candidates of each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on vec_id; candidates are all rows but the
    query's own. Several rows may have one vec_id: each is a candidate, and the
    one with the least vector asks. Ties go to the smaller vec_id; a query with
    fewer candidates than k returns all. Shorter vectors end in zeros. No vector
    gives no row.
    """
    whole = settled(whole_vectors(vectors, column), "vectors")
    asking = whole.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "row", "norm")).alias("q")).select("vec_id", "q.*")
    seen = whole.agg(F.max(F.size("v")).alias("width"), F.count(F.when(is_query, 1)).alias("n")).first()
    width, parts = max(seen["width"] or 1, 1), max(1, math.ceil(seen["n"] / QUERIES))
    turn = rotation(whole, width)
    packed = settled(blocks(whole, width), "blocks")
    asked = asking.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

    def in_parts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part").agg(F.collect_list(F.struct("vec_id", "row", "v", "least")).alias("q"), F.min("least").alias("lowest"), F.max("norm").alias("longest"))

    everyone = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    head = packed.orderBy(F.desc("most"), "block").limit(1).withColumn("part", everyone)
    first = settled(scored(head.join(in_parts(asked.withColumn("least", F.lit(float("nan")))), "part"), turn, k), "first")
    reached = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("reached"))
    queries = settled(in_parts(asked.join(reached, "vec_id", "left").withColumn("least", F.coalesce("reached", F.lit(float("-inf"))))), "queries")
    head_block = head.select("block").limit(1).collect()
    others = packed.where(F.col("block") != (head_block[0]["block"] if head_block else 0))
    pairs = others.select("block", "most", everyone.alias("part")).join(queries.select("part", "lowest", "longest"), "part").where(
        F.col("most") * F.col("longest") * (1 + SLACK) + SLACK >= F.col("lowest")).select("block", "part")
    met = pairs.join(queries.select("part", "q"), "part").join(others.select("block", "ids", "numbers", "rows"), "block")
    found = first.union(scored(met.repartition("block", "part"), turn, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
