"""Helpers that several operators share: words of whole texts, and text columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, as the operators on words read it: anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case, other letters as they are."""
    return text.lower().split()


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null reads as empty."""
    column = batch.column(name).cast(pa.binary())
    return [t or b"" for t in column.to_pylist()]


def table_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash with the operator's own."""
    return df.select(*[df[n] for n in names])


def remainder(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def chunks_of(batch: pa.RecordBatch, name: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``size`` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def first_by_hash(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose key has the smallest hashes; rows whose keys have large ones never leave their task."""
    n, space = df.count(), 1 << 30
    rank = F.pmod(F.xxhash64(key), F.lit(space))
    near = df.where(rank < int(space * min(1.0, 1.2 * most / max(n, 1)) + 1))
    return near.orderBy(rank, key).limit(most)
