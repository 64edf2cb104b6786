"""Benchmark decontamination: a block-max BM25 index of the test items, queried by every training passage.

A text is cut into overlapping passages, long enough that any item lies whole
in one of them. Scores are BM25 sums over a passage's distinct words, divided by
the item's score against itself, so that one threshold serves all items. A term
whose impacts cannot lift an item over the threshold without others is not
looked up; the items that the others reach are bounded first by the maxima of
their block, then by their own, and scored in full only above the threshold.
What is retrieved is confirmed by the five-word shingles of question and answer.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import chunks_of, table_of, texts_of, words

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage needs.
THRESHOLD = 0.6
#: Share of an item's score that terms left out of the index may hold.
LEFT_OUT = 0.3
#: Items of a block.
BLOCK = 8
#: Words of a shingle, and the share of them that confirms.
SHINGLE, LEAST_OVERLAP = 5, 0.8
#: Bytes of item text that one index holds; a larger benchmark is searched index by index.
INDEX_BYTES = 8 << 20
#: Items longer than this are searched by near-equal parts of at most this many words, and confirmed as a whole.
LONGEST = 512
SLICE = 4 << 20


def shingles(own: list[bytes]) -> set[bytes]:
    """Runs of SHINGLE words, or the whole of a shorter sequence."""
    return {b" ".join(own[i:i + SHINGLE]) for i in range(max(1, len(own) - SHINGLE + 1))} if own else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words before and after the last sentence end or line break inside the text; without one, all are the question."""
    body = text.rstrip()
    cuts = [i for i, c in enumerate(body[:-1]) if c in ".?!\n" and body[i + 1].isspace() or c == "\n"]
    cut = cuts[-1] + 1 if cuts else len(body)
    return words(body[:cut].encode()), words(body[cut:].encode())


class Index:
    """Postings with impacts of the items' telling terms, and their block maxima."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        self.around: list[tuple[int, int]] = []  # by part: words of the item ahead of it and behind it
        for item_id, text in sorted(items):
            question, answer = question_and_answer(text)
            own = question + answer
            asked, answered = shingles(question), shingles(answer)
            parts = -(-len(own) // LONGEST)
            for k in range(parts):
                at, end = k * len(own) // parts, (k + 1) * len(own) // parts
                self.items.append((item_id, own[at:end], asked, answered))
                # As much again as a part, for words that a copy has more.
                self.around.append((at + LONGEST, len(own) - end + LONGEST) if parts > 1 else (0, 0))
        n = len(self.items)
        self.longest = max((len(p) for _, p, _, _ in self.items), default=0)
        mean = sum(len(p) for _, p, _, _ in self.items) / max(n, 1)
        df = Counter(t for _, p, _, _ in self.items for t in set(p))
        self.terms: dict[bytes, int] = {}
        self.impact: list[dict[int, float]] = []  # by item: term number -> share of the item's own score
        self.open = np.zeros(n)  # by item: what the terms that are not looked up may add
        telling: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, part, _, _) in enumerate(self.items):
            tf = Counter(part)
            score = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(part) / mean)) for t, f in tf.items()}
            total = sum(score.values())
            own = {self.terms.setdefault(t, len(self.terms)): s / total for t, s in score.items()}
            self.impact.append(own)
            for t, s in sorted(own.items(), key=lambda x: (x[1], x[0])):
                if self.open[i] + s <= LEFT_OUT:
                    self.open[i] += s
                else:
                    telling[t].append((i, s))
        # CSR postings of the telling terms, by item and by block; term numbers that have none are empty.
        self.by_item = self._csr({t: p for t, p in telling.items()})
        blocks: dict[int, list[tuple[int, float]]] = {}
        for t, p in telling.items():
            most: dict[int, float] = {}
            for i, s in p:
                most[i // BLOCK] = max(most.get(i // BLOCK, 0.0), s)
            blocks[t] = sorted(most.items())
        self.by_block = self._csr(blocks)
        self.block_open = np.array([self.open[b:b + BLOCK].max() for b in range(0, n, BLOCK)])
        self.telling = {t: k for t, k in self.terms.items() if k in telling}

    def _csr(self, postings: dict[int, list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(postings.get(t, ())) for t in range(len(self.terms))], np.int64)
        flat = [x for t in range(len(self.terms)) for x in postings.get(t, ())]
        return np.concatenate(([0], np.cumsum(size))), np.array([i for i, _ in flat], np.int64), np.array([s for _, s in flat])

    @staticmethod
    def _sums(window: np.ndarray, term: np.ndarray, csr: tuple, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(window * width + target, summed impact) over distinct (window, term) pairs."""
        at, target, impact = csr
        n = at[term + 1] - at[term]
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[term], n)
        key, back = np.unique(np.repeat(window, n) * width + target[pos], return_inverse=True)
        return key, np.bincount(back, weights=impact[pos], minlength=len(key))

    def search(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(text, item_id, first word, score, question overlap, answer overlap) of the passages that hold an item."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not self.items or not len(texts) or not ends[-1]:
            return
        ids = np.fromiter(map(self.telling.get, chain.from_iterable(texts), repeat(-1)), np.int64, ends[-1])
        at = np.flatnonzero(ids >= 0)
        # Passages start every ``stride`` words and are twice as long: an item lies whole in one of them.
        stride = max(self.longest, 64)
        row = np.searchsorted(ends, at, side="right")
        k = (at - (ends - sizes)[row]) // stride
        passages = sizes // stride + 1
        base = np.cumsum(passages) - passages
        window = base[row] + k
        pairs = np.unique(np.concatenate([window, window - (k > 0)]) * len(self.terms) + np.concatenate([ids[at], ids[at]]))
        window, term = pairs // len(self.terms), pairs % len(self.terms)
        n_blocks, n_items = len(self.block_open), len(self.items)
        blocks, bound = self._sums(window, term, self.by_block, n_blocks)
        blocks = blocks[bound + self.block_open[blocks % n_blocks] >= THRESHOLD - 1e-9]
        kept = np.isin(window, blocks // n_blocks)
        found, bound = self._sums(window[kept], term[kept], self.by_item, n_items)
        window, item = found // n_items, found % n_items
        reach = (bound + self.open[item] >= THRESHOLD - 1e-9) & np.isin(window * n_blocks + item // BLOCK, blocks)
        row = np.searchsorted(base, window, side="right") - 1
        for r, w, i in zip(row[reach].tolist(), window[reach].tolist(), item[reach].tolist()):
            first = (w - int(base[r])) * stride
            passage = texts[r][first:first + 2 * stride]
            impact = self.impact[i]
            score = sum(sorted(impact.get(self.terms.get(t, -1), 0.0) for t in set(passage)))
            if score < THRESHOLD - 1e-9:
                continue
            item_id, _, question, answer = self.items[i]
            before, after = self.around[i]
            text = b" " + b" ".join(texts[r][max(0, first - before):first + 2 * stride + after]) + b" "
            held = [sum((b" " + s + b" ") in text for s in part) for part in (question, answer)]
            q, a = [h / len(part) if part else 1.0 for h, part in zip(held, (question, answer))]
            if min(q, a) >= LEAST_OVERLAP or sum(held) >= LEAST_OVERLAP * max(1, len(question) + len(answer)):
                yield r, item_id, first, score, q, a


def indexes(benchmark: DataFrame, most_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of at most ``most_bytes`` of text or so; null and empty items hold nothing to find."""
    items = table_of(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    held = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(held / most_bytes))
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        yield Index([(r["item_id"], r["text"]) for r in own.toLocalIterator() if r["text"].strip()])


def leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document row and item that it holds: doc_id, item_id, first_word, score, question_overlap, answer_overlap.

    Of several passages with the item the best by score counts, the first on ties.
    Null and empty texts hold no item. Repeated rows give repeated results; a null
    doc_id stays null. An empty benchmark or no document gives no row.
    """
    own = table_of(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
    found = None
    for index in indexes(benchmark, most_bytes):
        one = own.mapInArrow(_searched(index), schema)
        found = one if found is None else found.unionByName(one)
    return found


def _searched(index: Index):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                best: dict[tuple[int, int], tuple] = {}
                for row, item, *rest in index.search([words(t) for t in texts_of(part, "text")]):
                    if (row, item) not in best or rest[1] > best[row, item][1]:
                        best[row, item] = tuple(rest)
                if best:
                    at, *rest = zip(*((row, item, *x) for (row, item), x in sorted(best.items())))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(at)), *[pa.array(x) for x in rest]],
                        ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])

    return of


def _clean(index: Index):
    def of(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        at = 0
        for part in chunks_of(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE):
            for row, *_ in index.search([words(t) for t in texts_of(part, "text")]):
                out[at + row] = False
            at += part.num_rows
        return pa.array(out)

    return of


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept."""
    out = docs
    for index in indexes(benchmark, most_bytes):
        out = out.where(F.arrow_udf(_clean(index), "boolean", F.ArrowUDFType.SCALAR)(docs["text"]))
    return out
