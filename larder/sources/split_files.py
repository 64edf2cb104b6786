"""Quoted CSV and JSON arrays read in parallel: one file is as many tasks as it has blocks.

A block is the lines (or, for JSON, the stretches up to a closing brace) that
begin in a byte range of a file. What a line means depends on whether a quote or
an object is open where it begins. A first pass tells for every block what it
does to either state, the driver runs through these few rows (one per block, as
many as Spark's own plan of the scan has), and a second pass reads the blocks
with their states known. Records that reach over the border of blocks come out
in fragments, at most two per block, which are put together by their order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECES = "file string, block long, opens boolean, whole boolean, first boolean, value string"
PIECE_SCHEMA = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("opens", pa.bool_()), ("whole", pa.bool_()), ("first", pa.bool_()), ("value", pa.string()),
])
#: Records handed on at a time.
ROWS = 4096


def _stretches(spark: SparkSession, path, separator: str) -> DataFrame:
    """The stretches of text between separators, with the file and the first byte of the block that they begin in."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """((file, block), values) in the order of the task's rows; a block may come in several lists."""
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or blocks[i] != blocks[start] or files[i] != files[start]:
                yield (files[start], blocks[start]), values[start:i]
                start = i


# -- CSV -----------------------------------------------------------------------

def open_after(line: str, is_open: bool, delimiter: str = ",") -> bool:
    """Whether a quoted value is open behind a line; a quote opens a value only where one begins."""
    if '"' not in line:
        return is_open
    at, n = 0, len(line)
    while True:
        if is_open:
            # A doubled quote is a quote, a single one ends the value.
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            at, is_open = at + 1, False
        elif at < n and line[at] == '"' and (at == 0 or line[at - 1] == delimiter):
            at, is_open = at + 1, True
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False
        at += 1


def _csv_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, after_closed, after_open): the state behind a block for either state ahead of it."""
    states = {}
    for key, lines in _blocks(batches):
        closed, opened = states.get(key, (False, True))
        for line in lines:
            closed, opened = open_after(line, closed), open_after(line, opened)
        states[key] = closed, opened
    yield pa.record_batch({
        "file": pa.array([f for f, _ in states], pa.string()), "block": pa.array([b for _, b in states], pa.int64()),
        "after_closed": pa.array([s[0] for s in states.values()], pa.bool_()), "after_open": pa.array([s[1] for s in states.values()], pa.bool_())})


def _csv_pieces(open_at: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pieces("\n")
        for key, lines in _blocks(batches):
            if out.key != key:
                yield from out.begin(key, open_at[key])
            for line in lines:
                out.add(line, open_after(line, out.is_open))
            yield from out.full()
        yield from out.begin(None, False)

    return run


class _Pieces:
    """Collects the stretches of a block into records and the fragments at its ends."""

    def __init__(self, joint: str):
        self.joint, self.key, self.held, self.rows = joint, None, [], []
        self.is_open = self.begun = self.first = False

    def begin(self, key: tuple | None, is_open: bool) -> Iterator[pa.RecordBatch]:
        """End the block at hand, begin another one, inside a record if ``is_open``."""
        if self.held:
            self._put(whole=False)
        if self.rows:
            yield self._batch()
        self.key, self.is_open = key, is_open
        # Whether the record at hand begins in this block, and is the first of its file.
        self.begun, self.first = not is_open, key is not None and key[1] == 0

    def add(self, text: str, is_open: bool) -> None:
        self.held.append(text)
        self.is_open = is_open
        if not is_open:
            self._put(whole=self.begun)
            self.begun, self.first = True, False

    def _put(self, whole: bool) -> None:
        self.rows.append((*self.key, self.begun, whole, self.first, self.joint.join(self.held)))
        self.held = []

    def full(self) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= ROWS:
            yield self._batch()

    def _batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_SCHEMA)], schema=PIECE_SCHEMA)


def _records(pieces: DataFrame, joint: str) -> DataFrame:
    """(first, value) of whole records and of those put together from fragments, in any order."""
    parts = pieces.where(~F.col("whole"))
    # One row or two per block: the record that goes out of it and the one that comes in.
    in_file = Window.partitionBy("file").orderBy("block", "opens")
    parts = parts.withColumn("record", F.sum(F.col("opens").cast("int")).over(in_file))
    joined = parts.groupBy("file", "record").agg(
        F.bool_or("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), joint).alias("value"))
    return pieces.where("whole").select("first", "value").unionByName(joined.select("first", "value"))


def _run_through(states: DataFrame, step) -> dict:
    """{(file, block): state ahead of it}; ``step`` gives the state behind a block from the one ahead of it and its row."""
    ahead, file, state = {}, None, None
    for row in states.orderBy("file", "block").toLocalIterator():
        state = state if row["file"] == file else None
        file = row["file"]
        ahead[file, row["block"]], state = step(state, row)
    return ahead


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(first, value): the records of CSV files, line breaks inside quotes kept; ``first`` marks the first record of a file."""
    lines = _stretches(spark, path, "\n")
    states = lines.mapInArrow(_csv_states, "file string, block long, after_closed boolean, after_open boolean")

    def step(state, row):
        return bool(state), row["after_open"] if state else row["after_closed"]

    pieces = lines.mapInArrow(_csv_pieces(_run_through(states, step)), PIECES)
    records = _records(pieces, "\n")
    return records.select("first", F.regexp_replace("value", "\r\\z", "").alias("value"))


def parsed_csv(records: DataFrame, schema, options: dict, keep: Column) -> DataFrame:
    """Records as the columns of a schema; empty lines and records that ``keep`` leaves out give no row."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    return records.where(keep & (F.length("value") > 0)).select(F.from_csv("value", ddl, options).alias("_r")).select("_r.*")


# -- JSON arrays ---------------------------------------------------------------

INSIDE = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.S)
TEXT = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)


def after_stretch(text: str, in_text: bool) -> tuple[bool, int]:
    """(whether a text is open, levels gained) behind a stretch that the closing brace after it does not belong to."""
    if in_text:
        end = INSIDE.match(text).end()
        # A stretch that ends in a backslash escapes the separator, which no JSON does.
        if end >= len(text) or text[end] != '"':
            return True, 0
        text = text[end + 1:]
    bare = TEXT.sub("", text)
    at = bare.find('"')
    if at >= 0:
        bare = bare[:at]
    return at >= 0, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _after_brace(text: str, in_text: bool, last: bool) -> tuple[bool, int]:
    in_text, levels = after_stretch(text, in_text)
    return in_text, levels - (not in_text and not last)


def _json_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, for a text closed or open ahead of it: whether one is open behind it, and the levels gained; whether its file begins with an array."""
    states, heads = {}, {}
    for key, stretches in _blocks(batches):
        (a, da), (b, db) = states.get(key, ((False, 0), (True, 0)))
        if key not in heads or heads[key] is None:
            begun = "".join(stretches).lstrip("﻿ \t\r\n")
            heads[key] = begun[0] == "[" if begun else None
        for text in stretches:
            # What stands behind the last brace of a file lowers the level once too often, which nobody reads.
            a, n = _after_brace(text, a, False)
            da += n
            b, n = _after_brace(text, b, False)
            db += n
        states[key] = (a, da), (b, db)
    rows = [(*k, bool(heads[k]), *c, *o) for k, (c, o) in states.items()]
    names = ("file", "block", "array", "closed_text", "closed_levels", "open_text", "open_levels")
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    columns = list(zip(*rows)) or [()] * len(names)
    yield pa.record_batch({n: pa.array(c, k) for n, k, c in zip(names, kinds, columns)})


def _json_pieces(ahead: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, in_text, level, base = _Pieces(""), False, 0, 0
        for key, stretches in _blocks(batches):
            if out.key != key:
                in_text, level, base = ahead[key]
                yield from out.begin(key, in_text or level > base)
            for text in stretches:
                in_text, gained = _after_brace(text, in_text, False)
                level += gained
                out.add(text + "}", in_text or level > base)
            yield from out.full()
        yield from out.begin(None, False)

    return run


def json_array_records(spark: SparkSession, path) -> DataFrame:
    """(value): the objects of files that hold one JSON array, or one object; elements that are no objects are left out."""
    stretches = _stretches(spark, path, "}")
    states = stretches.mapInArrow(
        _json_states, "file string, block long, array boolean, closed_text boolean, closed_levels long, open_text boolean, open_levels long")

    def step(state, row):
        in_text, level, base = state or (False, 0, 1 if row["array"] else 0)
        kind = "open" if in_text else "closed"
        return (in_text, level, base), (row[f"{kind}_text"], level + row[f"{kind}_levels"], base)

    pieces = stretches.mapInArrow(_json_pieces(_run_through(states, step)), PIECES)
    value = _records(pieces, "").select("value").where(F.contains("value", F.lit("{")))
    return value.select(F.substring("value", F.instr("value", "{"), F.length("value")).alias("value"))
