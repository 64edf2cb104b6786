"""SimHash near-duplicates found by anchor points of a covering code.

The 64 bits are cut into three blocks. Of two fingerprints with at most four
differing bits, one block has at most one. In each block the anchors are the
codewords of a covering code of radius 1: the Hamming code of length 15, with
the block's other bits free. A fingerprint's home is its nearest anchor; it is
also sent to every anchor within radius plus threshold, 1 + 1. Whatever differs
from it by one bit in the block has its home among these, so comparing homes
with all that reached the anchor finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import chunks_of, table_of, texts_of, words
from larder.llm.components import components
from larder.session import settled

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: (first bit, bits) of the blocks. One block of each linked pair has at most MOST_BITS // 3 = 1 differing bits.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Length of the Hamming code; the code's own bits are the lowest of a block.
CODE = 15
#: Members of an anchor that one task compares at once; larger anchors are cut into pairs of parts.
PART = 16384
#: Pairs that are compared in one numpy call.
PAIRS = 1 << 21
SLICE = 4 << 20


def fingerprint(text: bytes) -> int:
    """64 bits, each set if it is set in over half the XXH64 of the text's shingles; 0 without words."""
    own = words(text)
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(own) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(own)) - 1:] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    count = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at:at + 8192]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                fps = np.array([fingerprint(t) for t in texts_of(part, "text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table_of(docs, "doc_id", "text").mapInArrow(of, f"doc_id {kind}, fp long")


def syndrome(values: np.ndarray) -> np.ndarray:
    """Of the low CODE bits: the position (from 1) at which the nearest codeword differs, 0 for a codeword."""
    out = np.zeros(len(values), np.int64)
    for bit in range(CODE):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


def anchors(block: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within distance 2 of each block value; a row's first one is its home."""
    wrong = syndrome(block)
    home = np.where(wrong > 0, block ^ (1 << np.maximum(wrong - 1, 0)), block)
    near = wrong > 0
    rows, found = [np.arange(len(block))], [home]

    def add(mask: np.ndarray, flip: int) -> None:
        rows.append(np.flatnonzero(mask))
        found.append(home[mask] ^ flip)

    free = range(CODE, bits)
    for a in free:
        add(np.ones(len(block), bool), 1 << a)  # 1 + 1, or 0 + 1
        for b in range(a + 1, bits):
            add(~near, (1 << a) | (1 << b))  # 0 + 2
    # Off a codeword, the other codewords at distance 2 flip two bits whose positions sum (xor) to the wrong one.
    for a in range(1, CODE + 1):
        b = wrong ^ a
        mask = near & (b > a)
        rows.append(np.flatnonzero(mask))
        found.append(block[mask] ^ (1 << (a - 1)) ^ (1 << (b[mask] - 1)))
    return np.concatenate(rows), np.concatenate(found)


def replicated(distinct: DataFrame) -> DataFrame:
    """(anchor, home, fp, id) rows: every fingerprint at every anchor within reach."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                for k, (first, bits) in enumerate(BLOCKS):
                    block = (fps >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    rows, found = anchors(block, bits)
                    home = np.zeros(len(rows), bool)
                    home[:len(block)] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found | k << 24), pa.array(home), pa.array(fps[rows].view(np.int64)), pa.array(ids[rows])],
                        ["anchor", "home", "fp", "id"])

    return distinct.mapInArrow(of, "anchor long, home boolean, fp long, id long")


def spanning(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """The links that join two trees of the forest ``parent``, which they extend."""

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def links_of(homes: np.ndarray, home_ids: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> tuple[list, list]:
    """Links of one anchor, thinned to those that join what was not joined before."""
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    step = max(1, PAIRS // len(fps))
    label = np.arange(len(fps))
    for at in range(0, len(homes), step):
        close = np.bitwise_count(homes[at:at + step, None] ^ fps[None, :]) <= MOST_BITS
        for i in range(close.shape[0]):
            near = np.flatnonzero(close[i])
            if len(near) == 1:  # its own row
                continue
            # One link per tree that this home reaches is enough.
            trees, first = np.unique(label[near], return_index=True)
            out += spanning(np.full(len(first), home_ids[at + i]), ids[near[first]], parent)
            if len(trees) > 1:
                label[np.isin(label, trees[1:])] = trees[0]
    return [x for x, _ in out], [y for _, y in out]


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from rows sorted by their comparison key; a key has 2 PART rows or so."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table.column("key").to_numpy()
        home = table.column("home").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        ids = table.column("id").to_numpy()
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        size = ends - starts
        run = np.repeat(np.arange(len(size)), size)
        n_home = np.bincount(run, weights=home, minlength=len(size)).astype(np.int64)
        u, v = [], []
        small = n_home * size <= 4096
        # Anchors with few pairs are compared together, pair list by pair list.
        rows = np.flatnonzero(home & small[run])
        for at in range(0, len(rows), 8192):
            mine = rows[at:at + 8192]
            n = size[run[mine]]
            left = np.repeat(mine, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[run[mine]], n)
            close = (np.bitwise_count(fps[left] ^ fps[right]) <= MOST_BITS) & (left != right)
            a, b, at_run = ids[left[close]], ids[right[close]], run[left[close]]
            if len(a) <= 4 * len(mine):
                u += a.tolist()
                v += b.tolist()
            else:
                for r in np.unique(at_run):
                    kept = spanning(a[at_run == r], b[at_run == r], {})
                    u += [x for x, _ in kept]
                    v += [y for _, y in kept]
        for r in np.flatnonzero(~small):
            s, e = starts[r], ends[r]
            own = np.flatnonzero(home[s:e]) + s
            a, b = links_of(fps[own], ids[own], fps[s:e], ids[s:e])
            u += a
            v += b
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 1 << 17:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if whole:
            yield from flush(table.slice(0, whole))
            table = table.slice(whole)
        held, rows = table.to_batches(), table.num_rows
    if held:
        yield from flush(pa.Table.from_batches(held))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) ids of linked fingerprints from (fp, id); enough of the links to keep every component whole."""
    rows = settled(replicated(distinct), "anchors")
    large = rows.groupBy("anchor").count().where(F.col("count") > PART)
    parts = large.select("anchor", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    sized = rows.join(settled(parts, "large"), "anchor", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    # Homes of part i meet the rows of part j under the key (anchor, i, j).
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    homes = sized.where("home").select("anchor", own.alias("i"), other.alias("j"), "home", "fp", "id")
    others = sized.where(~F.col("home")).select("anchor", other.alias("i"), own.alias("j"), "home", "fp", "id")
    # A home is also one of the rows of its own part, and of the parts of other homes.
    again = sized.where(F.col("home") & F.col("parts").isNotNull()).select(
        "anchor", other.alias("i"), own.alias("j"), F.lit(False).alias("home"), "fp", "id").where("i <> j")
    keyed = homes.union(others).union(again).select(F.xxhash64("anchor", "i", "j").alias("key"), "home", "fp", "id")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compared, "u long, v long")


def clustered(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest doc_id reachable, its own included).

    A null or empty text has the fingerprint 0 and is linked like any other.
    Rows without a doc_id take no part in links and have a null component. Rows
    that share a doc_id are links between their fingerprints. No row gives no row.
    """
    own = settled(with_fingerprints(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "fp"), "fingerprints")
    known = own.where("doc_id is not null")
    distinct = settled(known.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    ids = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1 and a <> b")
    found = links(distinct)
    repeated = settled(known.join(ids.select("doc_id"), "doc_id", "left_semi").distinct(), "repeated")
    if not repeated.isEmpty():
        named = repeated.join(distinct, "fp").select("doc_id", "id")
        least = named.groupBy("doc_id").agg(F.min("id").alias("least"))
        found = found.union(named.join(least, "doc_id").select(F.col("id").alias("u"), F.col("least").alias("v")))
    joined = components(settled(found, "found"))
    named = settled(distinct.join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")), "named")
    return own.join(named, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the smallest id stays.

    Rows without a doc_id stay. Of several rows with the id that stays, one stays,
    the one with the smallest hash of its text.
    """
    found = settled(clustered(docs), "clustered")
    kept = found.where("doc_id = component_id").groupBy("doc_id").count()
    once = docs.join(settled(kept.where("count = 1").select("doc_id"), "once"), "doc_id", "left_semi")
    several = docs.join(settled(kept.where("count > 1").select("doc_id"), "several"), "doc_id", "left_semi")
    whole = several.select("doc_id", F.struct(*[several[c] for c in docs.columns]).alias("row"))
    first = whole.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*")
    return once.unionByName(first).unionByName(docs.where("doc_id is null")).select(*docs.columns)
