"""Ratcliff-Obershelp similarity of normalised names.

Spark has no such function. ``similarity`` scores pairs that are already rows;
``best_in_block`` and ``match_counts_in_block`` compare two lists of names and
give one result per name of the first list, so that no pair ever becomes a row.
The distinct pairs of a whole batch of lists are bounded at once, and only those
whose bound leaves them a chance are scored, each once.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from larder.functions.text import norm_text, token_overlap


def ratio(item: str, ingredient: str) -> float:
    """2M/T of two normalised names; 0 where one is empty. The order of the names matters."""
    if not item or not ingredient:
        return 0.0
    return SequenceMatcher(None, item, ingredient).ratio()


def letter_counts(names) -> np.ndarray:
    """Characters per name as a count matrix (code point modulo 64: a bound stays a bound)."""
    counts = np.zeros((len(names), 64), dtype=np.int32)
    for i, name in enumerate(names):
        codes = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32) % 64
        counts[i] = np.bincount(codes, minlength=64)
    return counts


def upper_bounds(counts: np.ndarray, lengths: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """No name can score above 2 * (common characters) / (total length)."""
    common = np.minimum(counts, own).sum(axis=1)
    return 2.0 * common / np.maximum(lengths + length, 1)


class Remembered:
    """``ratio`` of pairs of names, with a bounded memory that lasts for a task: names repeat heavily between users."""

    MOST = 300_000

    def __init__(self):
        self.known = {}

    def scores(self, pairs: list[tuple[str, str]]) -> list[float]:
        """Scores of (item, ingredient) pairs; pairs of one ingredient share what is prepared for it."""
        if len(self.known) + len(pairs) > self.MOST:
            self.known = {}
        fresh = {}
        for item, ingredient in pairs:
            if (item, ingredient) not in self.known:
                fresh.setdefault(ingredient, []).append(item)
        for ingredient, items in fresh.items():
            matcher = SequenceMatcher(None, "", ingredient)
            for item in items:
                matcher.set_seq1(item)
                self.known[item, ingredient] = matcher.ratio() if item and ingredient else 0.0
        return [self.known[p] for p in pairs]


class Names:
    """Distinct names of a batch, prepared for bounds: letter counts, lengths, letters as numbers of an alphabet."""

    # Names up to this length fit the machine word of the bit-parallel scan.
    WORD = 63

    def __init__(self, names: list[str]):
        self.names = names
        self.counts = letter_counts(names)
        self.lengths = np.array([len(n) for n in names], dtype=np.int64)

    def places(self, alphabet: dict) -> np.ndarray:
        """Letters as numbers, zeros behind the ends; letters that the alphabet lacks are zero too."""
        out = np.zeros((len(self.names), int(self.lengths.max(initial=0))), dtype=np.intp)
        for i, name in enumerate(self.names):
            out[i, :len(name)] = [alphabet.get(c, 0) for c in name]
        return out

    def masks(self, alphabet: dict) -> np.ndarray:
        """Per name and letter the places of the letter as bits; nothing for names that are too long."""
        out = np.zeros((len(self.names), len(alphabet) + 1), dtype=np.uint64)
        for i, name in enumerate(self.names):
            if len(name) <= self.WORD:
                for bit, c in enumerate(name):
                    out[i, alphabet[c]] |= np.uint64(1 << bit)
        return out


def _numbered(keys: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below ``space`` in order, and the number of each key among them; marked in a table unless the keys are few for it."""
    if space > 8 * len(keys):
        return np.unique(keys, return_inverse=True)
    there = np.zeros(space, dtype=bool)
    there[keys] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int64) - 1)[keys]


class Pairs:
    """The distinct pairs of (ingredient, item) names of a batch of lists, each bounded and scored once."""

    # Pairs of names looked at in one go.
    MOST = 1 << 19

    def __init__(self, lefts: list, rights: list, memory: Remembered):
        """``lefts`` and ``rights``: for every row its ingredient names and its item names."""
        self.memory = memory
        left_of, right_of = {}, {}
        sizes = [(len(a), len(b)) for a, b in zip(lefts, rights)]
        a_ids = [np.array([left_of.setdefault(n, len(left_of)) for n in names], dtype=np.int64) for names in lefts]
        b_ids = [np.array([right_of.setdefault(n, len(right_of)) for n in names], dtype=np.int64) for names in rights]
        self.left, self.right = Names(list(left_of)), Names(list(right_of))
        # One segment per ingredient of a row; its candidates are the row's items, in their order.
        self.segment = np.repeat(np.arange(sum(a for a, _ in sizes)), np.repeat([b for _, b in sizes], [a for a, _ in sizes]).astype(np.int64))
        self.at = np.concatenate([np.tile(np.arange(b), a) for a, b in sizes] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        every = np.concatenate([np.repeat(a, len(b)) * len(right_of) + np.tile(b, len(a)) for a, b in zip(a_ids, b_ids)] or [np.zeros(0, dtype=np.int64)])
        keys, self.pair = _numbered(every, len(left_of) * len(right_of))
        self.a, self.b = keys // max(len(right_of), 1), keys % max(len(right_of), 1)

    def bounds(self, min_score: float) -> np.ndarray:
        """No pair can score above its bound; bounds under ``min_score`` are by common letters only."""
        total = np.maximum(self.left.lengths[self.a] + self.right.lengths[self.b], 1)
        common = np.zeros(len(self.a), dtype=np.int64)
        for lo in range(0, len(self.a), self.MOST // 8):
            part = slice(lo, lo + self.MOST // 8)
            common[part] = np.minimum(self.left.counts[self.a[part]], self.right.counts[self.b[part]]).sum(axis=1)
        bounds = 2.0 * common / total
        near = np.flatnonzero((bounds >= min_score) & (self.left.lengths[self.a] <= Names.WORD))
        if len(near):
            bounds[near] = np.minimum(bounds[near], 2.0 * self._subsequences(self.a[near], self.b[near]) / total[near])
        return bounds

    def _subsequences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences, which no sum of matching blocks exceeds."""
        alphabet = {c: i + 1 for i, c in enumerate(sorted({c for n in self.left.names for c in n}))}
        masks, places = self.left.masks(alphabet), self.right.places(alphabet)
        sizes = self.left.lengths[a].astype(np.uint64)
        whole = (np.uint64(1) << sizes) - np.uint64(1)
        free = whole.copy()
        for column in range(places.shape[1]):
            hit = free & masks[a, places[b, column]]
            free = (free + hit) | (free - hit)
        return self.left.lengths[a] - np.bitwise_count(free & whole).astype(np.int64)

    def scored(self, pairs: np.ndarray) -> np.ndarray:
        """Scores of some of the distinct pairs, each asked for once."""
        some, back = np.unique(pairs, return_inverse=True)
        names = [(self.right.names[j], self.left.names[i]) for i, j in zip(self.a[some].tolist(), self.b[some].tolist())]
        return np.array(self.memory.scores(names), dtype=float)[back]

    def best(self, min_score: float) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the best item of every segment, the first of equals; place -1 below ``min_score``.

        Candidates are scored by falling bound, one of every segment at a time, until no bound reaches the best score.
        """
        n = int(self.segment[-1]) + 1 if len(self.segment) else 0
        bound = self.bounds(min_score)[self.pair]
        kept = np.flatnonzero(bound >= min_score)
        kept = kept[np.lexsort((self.at[kept], -bound[kept], self.segment[kept]))]
        segment = self.segment[kept]
        ends = np.searchsorted(segment, np.arange(n), side="right")
        next_one = np.searchsorted(segment, np.arange(n), side="left")
        best, place = np.zeros(n), np.full(n, -1)
        alive = np.flatnonzero(next_one < ends)
        while len(alive):
            now = kept[next_one[alive]]
            worth = bound[now] >= best[alive]
            alive, now = alive[worth], now[worth]
            if not len(alive):
                break
            score = self.scored(self.pair[now])
            better = (score > best[alive]) | ((score == best[alive]) & (place[alive] >= 0) & (self.at[now] < place[alive]))
            best[alive[better]], place[alive[better]] = score[better], self.at[now][better]
            next_one[alive] += 1
            alive = alive[next_one[alive] < ends[alive]]
        place[best < min_score] = -1
        return place, best

    def counts(self, min_score: float) -> np.ndarray:
        """Per segment the number of items that share a word with it or are similar enough."""
        left, right = ([frozenset(x.split()) for x in names.names] for names in (self.left, self.right))
        match = np.array([not left[i].isdisjoint(right[j]) for i, j in zip(self.a.tolist(), self.b.tolist())], dtype=bool)
        rest = np.flatnonzero(~match & (self.bounds(min_score) >= min_score)) if min_score <= 1 else np.zeros(0, dtype=np.int64)
        if len(rest):
            match[rest] = self.scored(rest) >= min_score
        n = int(self.segment[-1]) + 1 if len(self.segment) else 0
        return np.bincount(self.segment, weights=match[self.pair], minlength=n).astype(np.int64)


def _slices(lefts: list, rights: list):
    """Rows in slices of about ``Pairs.MOST`` pairs."""
    start, held = 0, 0
    for i, (a, b) in enumerate(zip(lefts, rights)):
        if held and held + len(a) * len(b) > Pairs.MOST:
            yield slice(start, i)
            start, held = i, 0
        held += len(a) * len(b)
    if start < len(lefts):
        yield slice(start, len(lefts))


def best_of_lists(lefts: list, rights: list, min_score: float, memory: Remembered) -> list:
    """For every row and name on its left the place and score of the best name on its right, the first of equals; None below ``min_score``."""
    out = []
    for part in _slices(lefts, rights):
        place, score = Pairs(lefts[part], rights[part], memory).best(min_score)
        found = [None if p < 0 else {"at": p, "score": s} for p, s in zip(place.tolist(), score.tolist())]
        out += _by_row(found, lefts[part], rights[part], None)
    return out


def counts_of_lists(lefts: list, rights: list, min_score: float, memory: Remembered) -> list:
    """For every row and name on its left the number of names on its right that match it."""
    out = []
    for part in _slices(lefts, rights):
        out += _by_row(Pairs(lefts[part], rights[part], memory).counts(min_score).tolist(), lefts[part], rights[part], 0)
    return out


def _by_row(values: list, lefts: list, rights: list, none) -> list:
    """The values of the segments, row by row; rows without items have no segments that say anything."""
    out, at = [], 0
    for a, b in zip(lefts, rights):
        own = values[at:at + len(a)]
        out.append([*own, *[none] * (len(a) - len(own))])
        at += len(a)
    return out


def _ratio_column(item: Column, ingredient: Column) -> Column:
    memory = Remembered()

    @pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        given = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
        scores = iter(memory.scores(given) if len(given) <= Remembered.MOST else [ratio(*p) for p in given])
        return pd.Series([None if x is None or y is None else next(scores) for x, y in zip(a, b)], dtype="float64")

    return score(item, ingredient)


def similarity(item: Column, ingredient: Column) -> Column:
    """Similarity of two names between 0 and 1; 0 where a normalised name is empty."""
    a, b = norm_text(item), norm_text(ingredient)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(_ratio_column(a, b))


def is_match(item: Column, ingredient: Column, min_score: float = 0.45) -> Column:
    """Whether two names share a word or are similar enough."""
    return token_overlap(item, ingredient) | F.coalesce(similarity(item, ingredient) >= min_score, F.lit(False))


def best_in_block(names: Column, items: Column, min_score: float) -> Column:
    """For every name of a list the best item of another list, as array<struct(at, score)>."""
    memory = Remembered()

    @pandas_udf("array<struct<at:int,score:double>>")
    def best(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(best_of_lists([list(a) for a in left], [list(b) for b in right], min_score, memory))

    return best(names, items)


def match_counts_in_block(names: Column, items: Column, min_score: float) -> Column:
    """For every name of a list the number of items of another list that match it."""
    memory = Remembered()

    @pandas_udf("array<int>")
    def counts_of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(counts_of_lists([list(a) for a in left], [list(b) for b in right], min_score, memory))

    return counts_of(names, items)
