"""Which texts contain which: a merge of sorted suffixes, and an automaton for tables of keywords.

``contained`` serves two large vocabularies. A part lies in a name when it opens
one of the name's suffixes; in one sorted list of suffixes and parts, the parts
that open a suffix stand before it and open each other. Rows grow with the
letters of the names, however many lengths the parts have.

``keyword_hits`` serves a table of rules. Rules are dealt to shards of bounded
size, texts to slices, and a task reads the texts of its slice once through the
automaton of its shard.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import settled, task_count

#: Boundaries are quantiles of about so many keys per slice.
SAMPLE = 64
#: Letters of the keywords in one automaton, and of the texts in one slice.
SHARD = 4 << 20
SLICE = 16 << 20


def _boundaries(keys: DataFrame, slices: int) -> list[str]:
    """At most ``slices`` - 1 keys that cut the sorted keys into slices of about one size, from a sample by hash."""
    n = keys.count()
    space = 1 << 30
    share = min(1.0, slices * SAMPLE / max(n, 1))
    near = F.pmod(F.xxhash64("key"), F.lit(space)) < int(space * share)
    sample = sorted(r[0] for r in keys.where(near).limit(4 * slices * SAMPLE).collect())
    return sorted({sample[len(sample) * i // slices] for i in range(1, slices)}) if sample else []


def _dealt(bounds: list[str]) -> Callable:
    """(key, part) rows with the slice of their key; a part is also sent to the slices that begin inside the suffixes it opens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices, keys, parts = [], [], []
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
                own = bisect_right(bounds, key)
                slices.append(own)
                keys.append(key)
                parts.append(part)
                at = bisect_left(bounds, key)
                while part and at < len(bounds) and bounds[at].startswith(key):
                    if at + 1 != own:
                        slices.append(at + 1)
                        keys.append(key)
                        parts.append(True)
                    at += 1
            yield pa.record_batch({"slice": pa.array(slices, pa.int32()), "key": pa.array(keys, pa.string()), "part": pa.array(parts, pa.bool_())})

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice and key, parts first -> (key, part) for every part that opens a suffix."""
    at, open_parts = None, []
    for batch in batches:
        keys, parts = [], []
        for place, key, part in zip(*(batch.column(c).to_pylist() for c in ("slice", "key", "part"))):
            if place != at:
                at, open_parts = place, []
            while open_parts and not key.startswith(open_parts[-1]):
                open_parts.pop()
            if part:
                open_parts.append(key)
            else:
                keys += [key] * len(open_parts)
                parts += open_parts
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "part": pa.array(parts, pa.string())})


def contained(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(_name, _part), each pair once: the parts that each name contains.

    ``names`` has distinct ``_name``, ``parts`` distinct ``_part``; empty parts lie in nothing.
    A suffix that many names end in is looked up once; the join back to the names is a
    plain one, of which Spark splits the large partitions.
    """
    parts = settled(parts.where(F.length("_part") > 0).select(F.col("_part").alias("key")), "parts")
    longest = parts.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).scalar()
    starts = F.sequence(F.lit(1), F.length("_name"))
    suffixes = settled(
        names.where(F.length("_name") > 0).withColumn("_longest", longest)
        .select("_name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_name"), i, F.col("_longest"))))).alias("key")),
        "suffixes")
    keys = settled(suffixes.select("key").distinct(), "keys")
    slices = task_count(names.sparkSession)
    rows = keys.withColumn("part", F.lit(False)).unionByName(parts.withColumn("part", F.lit(True)))
    found = (
        rows.mapInArrow(_dealt(_boundaries(keys, slices)), "slice int, key string, part boolean")
        .repartition(slices, "slice").sortWithinPartitions("slice", "key", F.desc("part"))
        .mapInArrow(_opened, "key string, part string")
    )
    return suffixes.join(found, "key").select("_name", F.col("part").alias("_part")).distinct()


def _first_hits(texts: pa.Table, rules: pa.Table) -> pa.Table:
    """(text, class, keyword, ord) for the first rule of every class that a text contains."""
    owners, hits = [], []
    if rules.num_rows and texts.num_rows:
        automaton, order = ahocorasick.Automaton(), rules.column("ord").to_pylist()
        words, classes = rules.column("keyword").to_pylist(), rules.column("class").to_pylist()
        rank = [(o is None, 0 if o is None else o, w) for o, w in zip(order, words)]
        of_word = defaultdict(list)
        for i, word in enumerate(words):
            of_word[word].append(i)
        for word in of_word:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for text in texts.column("text").to_pylist():
            first = {}
            for word in {w for _, w in automaton.iter(text)}:
                for i in of_word[word]:
                    known = first.get(classes[i])
                    if known is None or rank[i] < rank[known]:
                        first[classes[i]] = i
            owners += [text] * len(first)
            hits += first.values()
    chosen = rules.take(pa.array(hits, pa.int64()))
    return pa.table({
        "text": pa.array(owners, pa.string()), "class": chosen.column("class"), "keyword": chosen.column("keyword"), "ord": chosen.column("ord")})


def keyword_hits(texts: DataFrame, rules: DataFrame, shard: int = SHARD, piece: int = SLICE) -> DataFrame:
    """(text, class, keyword): per text and class the rule of lowest ``ord``, of equal ones the least keyword, that the text contains.

    ``texts`` has distinct ``text``, ``rules`` (class, keyword, ord). An automaton
    holds about ``shard`` letters of keywords, so more rules are more shards, each of
    which meets every text; a group holds about ``piece`` letters of texts. A null
    ``ord`` comes last; empty and null keywords lie in nothing.
    """
    spark = texts.sparkSession
    texts, rules = settled(texts.select("text"), "texts"), settled(rules.where(F.length("keyword") > 0).select("class", "keyword", "ord"), "rules")
    shards = math.ceil((rules.agg(F.sum(F.length("keyword"))).first()[0] or 0) / shard)
    slices = max(math.ceil((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / piece), task_count(spark))
    ord_type = dict(rules.dtypes)["ord"]
    # All rules of a keyword meet in one shard.
    dealt = rules.withColumn("shard", F.pmod(F.xxhash64("keyword"), F.lit(max(1, shards)))).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    read = texts.withColumn("slice", F.pmod(F.xxhash64("text"), F.lit(slices)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, shards) - 1).cast("long"))))
    schema = f"text string, class string, keyword string, ord {ord_type}"

    hits = read.groupBy("shard", "slice").cogroup(dealt.groupBy("shard", "slice")).applyInArrow(_first_hits, schema)
    return hits.groupBy("text", "class").agg(
        F.min_by("keyword", F.struct(F.col("ord").isNull().alias("late"), "ord", "keyword")).alias("keyword"))
