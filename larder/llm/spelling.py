"""Spelling variants: words that differ by one code point, found in tries of letter-group counts.

A word's path holds how many of its letters fall in each of GROUPS groups of
letters. Two words one edit apart have paths that differ by a surplus of at most
one and a deficit of at most one, so a depth-first search that may spend one of
each meets every partner; leaf words are then compared letter by letter.

The trie is dealt out by its upper levels: a word is stored below its own upper
counts, and looked up below all upper counts that its budget reaches. Upper
counts that hold many words are cut into parts by a hash of the word, and what
is looked up goes to each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import table_of
from larder.session import settled

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EVERY = 199
LEAST_LETTERS = 6
LEAST_N = 5
RATIO = 5

GROUPS = 12
UPPER = 4
PART = 4096
FEW = 16
CELLS = 1 << 21


def runs_of(text: Column) -> Column:
    """The letter runs of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, *LOWER), F.lit(RUN), F.lit(0))


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run without one code point where the hash of document and run says so; a null id reads as empty text."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the words in whole texts that are long and frequent enough; null texts have none."""
    runs = table_of(docs, "doc_id", "text").select("doc_id", F.explode(runs_of(F.col("text"))).alias("run"))
    return (
        runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least_letters)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)
    )


def group_of(codes: np.ndarray) -> np.ndarray:
    return codes % GROUPS


class Codes:
    """Code points of a list of words, one after the other, so that one long word pads no other."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def counts(self) -> np.ndarray:
        """Letters per group of each word."""
        word = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.bincount(word * GROUPS + group_of(self.flat), minlength=len(self.lengths) * GROUPS).reshape(-1, GROUPS)

    def padded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The words of some rows as a matrix, zeros behind their ends."""
        at = np.arange(width)
        inside = at < self.lengths[rows][:, None]
        return np.where(inside, self.flat[np.where(inside, self.starts[rows][:, None] + at, 0)], 0)


def verified(a: Codes, rows: np.ndarray, b: Codes, columns: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart, compared in slices of bounded size."""
    good = np.zeros(len(rows), dtype=bool)
    la, lb = a.lengths[rows], b.lengths[columns]
    near = np.flatnonzero(np.abs(la - lb) <= 1)
    near = near[np.argsort(la[near], kind="stable")]
    lo = 0
    while lo < len(near):
        hi = lo + 1 + max(0, int(np.searchsorted(np.arange(2, len(near) - lo + 1) * (la[near[lo + 1:]] + 2), CELLS)))
        own = near[lo:hi]
        width = int(max(la[own].max(), lb[own].max())) + 1
        good[own] = one_apart(a.padded(rows[own], width), la[own], b.padded(columns[own], width), lb[own])
        lo = hi
    return good


def one_apart(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether the padded words of each row differ by exactly one inserted, deleted or replaced code point."""
    width = a.shape[1]
    longer, shorter = np.where((la >= lb)[:, None], a, b), np.where((la >= lb)[:, None], b, a)
    n, least = np.maximum(la, lb), np.minimum(la, lb)
    same = longer == shorter
    replaced = (n == least) & ((~same).sum(axis=1) == 1)
    # Equal up to a place, and from the next place of the longer word on.
    head = np.argmin(same, axis=1)
    shifted = np.zeros_like(same)
    shifted[:, :-1] = longer[:, 1:] == shorter[:, :-1]
    columns = np.arange(width)
    rest = (shifted | (columns < head[:, None]) | (columns >= least[:, None])).all(axis=1)
    return replaced | ((n == least + 1) & ((head >= least) & ~same.all(axis=1) | rest))


class Trie:
    """Stored words of equal upper counts, sorted by their counts, so that a node is a range of rows."""

    def __init__(self, words: list[str]):
        self.codes = Codes(words)
        counts = self.codes.counts()
        self.order = np.lexsort(counts.T[::-1])
        self.counts = counts[self.order]

    def near(self, words: list[str], surplus: np.ndarray, deficit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(stored, looked up) positions of words one edit apart; surplus and deficit are what the upper counts left of each budget."""
        codes = Codes(words)
        counts = codes.counts()
        found = []
        # Depth first: a node is visited once, with all words whose budget reaches it.
        stack = [(UPPER, 0, len(self.order), np.arange(len(words)), surplus, deficit)]
        while stack:
            level, lo, hi, alive, more, less = stack.pop()
            if len(alive) == 0:
                continue
            if level == GROUPS or hi - lo <= FEW:
                rows, columns = np.repeat(np.arange(lo, hi), len(alive)), np.tile(np.arange(len(alive)), hi - lo)
                step = self.counts[rows, level:] - counts[alive[columns], level:]
                fits = (np.maximum(step, 0).sum(axis=1) <= more[columns]) & (np.maximum(-step, 0).sum(axis=1) <= less[columns])
                rows, columns = rows[fits], alive[columns[fits]]
                rows = self.order[rows]
                good = verified(self.codes, rows, codes, columns)
                found.append((rows[good], columns[good]))
                continue
            own = self.counts[lo:hi, level]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            have = counts[alive, level]
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), hi - lo]):
                step = own[s] - have
                fits = (step <= more) & (-step <= less)
                stack.append((level + 1, lo + s, lo + e, alive[fits], (more - np.maximum(step, 0))[fits], (less - np.maximum(-step, 0))[fits]))
        return found


def budget_paths() -> np.ndarray:
    """Every way to spend at most one surplus and one deficit on the upper counts, as steps per count."""
    out = [[0] * UPPER]
    for i in range(UPPER):
        for j in range(UPPER):
            step = [0] * UPPER
            step[i] += 1
            if i != j:
                step[j] -= 1
            out.append(step)
        out.append([-(k == i) for k in range(UPPER)])
    return np.array(out, dtype=np.int64)


def key_of(upper: np.ndarray) -> np.ndarray:
    """Upper counts as one number. Counts of 2^15 and more share the last number, which joins nodes and loses none."""
    key = np.zeros(len(upper), dtype=np.int64)
    for g in range(UPPER):
        key = key << 15 | np.minimum(upper[:, g], (1 << 15) - 1)
    return key


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) -> (node, word), the node being that of its upper counts."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        if words:
            yield pa.record_batch({"node": key_of(Codes(words).counts()[:, :UPPER]), "word": pa.array(words, pa.string())})


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) -> (node, word, surplus, deficit) for every node its budget reaches, with what is left."""
    steps = budget_paths()
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        upper = Codes(words).counts()[:, :UPPER]
        for step in steps:
            at = upper + step
            fits = np.flatnonzero((at >= 0).all(axis=1))
            yield pa.record_batch({
                "node": key_of(at[fits]), "word": pa.array([words[i] for i in fits.tolist()], pa.string()),
                "surplus": np.full(len(fits), 1 - max(0, step.max()), dtype=np.int32),
                "deficit": np.full(len(fits), 1 - max(0, -step.min()), dtype=np.int32)})


def pairs_of(key: tuple, entries: pa.Table, asked: pa.Table) -> pa.Table:
    """The words one edit apart of the node parts of a shard and of the words that reach them."""
    left, right = [], []
    own, words = (np.array(t.column("word").to_pylist(), dtype=object) for t in (entries, asked))
    budgets = [asked.column(c).to_numpy().astype(np.int64) for c in ("surplus", "deficit")]
    for rows, columns in matched(places_of(entries), places_of(asked)):
        found = Trie(own[rows].tolist()).near(words[columns].tolist(), *(b[columns] for b in budgets))
        left += [own[rows[i]] for i, _ in found]
        right += [words[columns[j]] for _, j in found]
    empty = [np.array([], dtype=object)]
    return pa.table({"word": pa.array(np.concatenate(right or empty), pa.string()), "near": pa.array(np.concatenate(left or empty), pa.string())})


def places_of(table: pa.Table) -> dict[tuple, np.ndarray]:
    """The rows of each part of a node."""
    node, part = (table.column(c).to_numpy() for c in ("node", "part"))
    order = np.lexsort((part, node))
    cuts = np.flatnonzero((np.diff(node[order]) != 0) | (np.diff(part[order]) != 0)) + 1
    return {(node[r[0]], part[r[0]]): r for r in np.split(order, cuts) if len(r)}


def matched(left: dict, right: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for key, rows in left.items():
        if key in right:
            yield rows, right[key]


def near_words(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, near) of all words one edit apart, both ways round; ``words`` has distinct words.

    A node with more than ``part`` words is cut by a hash of the word into parts of
    about that size; words that are looked up go to every part, since any may hold a
    partner. A task of the search takes a shard, which holds parts of many nodes.
    """
    entries = words.select("word").mapInArrow(stored, "node long, word string")
    sizes = settled(entries.groupBy("node").agg(F.count(F.lit(1)).alias("held")).withColumn("parts", F.ceil(F.col("held") / part)), "nodes")
    shards = max(1, math.ceil((sizes.agg(F.sum("held")).first()[0] or 0) / part))
    shard = F.pmod(F.xxhash64("node", "part"), F.lit(shards))
    sizes = sizes.drop("held")
    entries = entries.join(sizes, "node").select("node", F.pmod(F.xxhash64("word"), F.col("parts")).alias("part"), "word")
    asked = (
        words.select("word").mapInArrow(looked_up, "node long, word string, surplus int, deficit int")
        .join(sizes, "node").select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "word", "surplus", "deficit")
    )
    dealt = [df.withColumn("shard", shard).groupBy("shard") for df in (entries, asked)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(pairs_of, "word string, near string")


def variants(words: DataFrame, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    The form is the near word of largest n, the smallest of equal ones, if its n is
    at least ``ratio`` times the word's; the root is the end of the chain of forms,
    which is short, as n grows by ``ratio`` with every step. Words without near words
    have n_near 0 and are their own root. An empty vocabulary gives no rows.
    """
    words = settled(words.select("word", "n"), "words")
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        near_words(words, part).join(other, "near").groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    )
    top = -F.col("best.minus")
    formed = settled(
        words.join(best, "word", "left").withColumn("form", F.when(top >= ratio * F.col("n"), F.col("best.near")))
        .select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), top).alias("form_n")),
        "formed")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: every round each link skips as many steps as it already spans."""
    links = settled(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settled(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        links = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return links
