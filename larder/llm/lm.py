"""Log-likelihood of whole documents under a gated recurrent language model.

The words that occur most are output symbols of their own, in classes of equal
size: the network gives a class, then a word of it. All other words are one
more class, in which a word has its share of the training counts; a word that
training lacks has the share of one unseen count. So every text has a proper
probability.

Counts cover all training texts. The recurrent weights are learnt in numpy by
truncated backpropagation on all training texts as well, in rounds that share the
rows out: each partition trains from the same weights in its own task, then the
weights are averaged by the tokens that they have seen. Scoring reads every text
whole; the state goes on from window to window and starts anew with each document.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import chunks_of, table_of, texts_of, words
from larder.session import settled

#: Classes and words of a class. Symbol 0 is the end; the most frequent words follow.
CLASSES, MEMBERS = 32, 64
SYMBOLS = CLASSES * MEMBERS
OTHER = SYMBOLS
#: Words, at most, whose counts travel with the code, the most frequent ones; the counts of others are joined.
HEAD = 1 << 16
EMBEDDED, STATE = 16, 16
#: Rounds, each over its share of all rows; rows of fewer tokens than this are read again and again, for so many windows at most.
ROUNDS, LEAST_TOKENS, WINDOWS = 2, 3_000_000, 250
#: Least and most lanes, and steps of a training window; tokens that are dealt to lanes together, and of a piece of a text, whose state starts anew.
LANES, WIDEST, STEPS = 32, 256, 32
DEALT, PIECE = 1_000_000, 2048
#: Weights of partitions that are summed in one task.
FAN = 64
#: Steps of a scoring window, tokens and lanes that are scored together.
LONG_STEPS, TOGETHER, MOST_LANES = 64, 4_000_000, 512
RATE = 4e-3
SLICE = 4 << 20
FLUSH = 300_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all words of the texts; the empty word stands for the ends, one a text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
            count.clear()
            return out

        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                for text in texts_of(part, "text"):
                    count.update(words(text))
                    count[b""] += 1
                    if len(count) > FLUSH:
                        yield flush()
        yield flush()

    return table_of(docs, "text").mapInArrow(of, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What all training texts hold: tokens, distinct tokens, texts, and the counts of the most frequent words."""

    tokens: int
    distinct: int
    texts: int
    head: list[bytes]
    head_counts: np.ndarray

    @property
    def unit(self) -> float:
        """The base's denominator."""
        return self.tokens + self.distinct + 1

    @property
    def other(self) -> tuple[int, int]:
        """Tokens and distinct words that are no symbols of their own."""
        own = self.head_counts[:SYMBOLS - 1]
        return self.tokens - self.texts - int(own.sum()), self.distinct - (self.texts > 0) - len(own)


def gathered(counts: DataFrame, most: int = HEAD) -> Counts:
    total = counts.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v"), F.sum(F.when(F.octet_length("word") == 0, F.col("n"))).alias("texts")).first()
    texts = total["texts"] or 0
    own = counts.where(F.octet_length("word") > 0)
    # Eighths of a doubling: few groups, from which the count follows that at most ``most`` words reach.
    step = F.floor(F.log2("n") * 8)
    cut, held = 0, 0
    for r in sorted(own.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > most:
            cut = r["step"] + 1
            break
    head = sorted(own.where(step >= cut).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    return Counts(total["n"] or 0, (total["v"] or 0), texts, [bytes(r["word"]) for r in head], np.array([r["n"] for r in head], np.int64))


class Network:
    """The weights, by name; 32-bit."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def initial(cls, counts: Counts) -> "Network":
        """Random recurrent weights; the output's offsets are the logarithms of the counts' shares."""
        rng = np.random.default_rng(11)
        normal = lambda *shape: (rng.normal(size=shape) / math.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
        own = np.zeros(SYMBOLS)
        own[0] = counts.texts
        n = counts.head_counts[:SYMBOLS - 1]
        own[1:len(n) + 1] = n
        table = own.reshape(CLASSES, MEMBERS)
        shares = np.append(table.sum(axis=1), counts.other[0]) + 0.5
        inside = (table + np.where(table > 0, 0, 1e-9)) / np.maximum(table.sum(axis=1, keepdims=True), 1e-9)
        return cls({
            "embed": normal(SYMBOLS + 1, EMBEDDED), "input": normal(EMBEDDED, 3 * STATE), "state": normal(STATE, 3 * STATE),
            "offset": np.zeros(3 * STATE, np.float32), "class": 0.1 * normal(STATE, CLASSES + 1),
            "class_offset": np.log(shares / shares.sum()).astype(np.float32), "member": 0.1 * normal(CLASSES, STATE, MEMBERS),
            "member_offset": np.maximum(np.log(np.maximum(inside, 1e-30)), -30).astype(np.float32)})

    def packed(self) -> bytes:
        return b"".join(v.astype(np.float32).tobytes() for v in self.w.values())

    def unpacked(self, data: np.ndarray) -> "Network":
        out, at = {}, 0
        for k, v in self.w.items():
            out[k] = data[at:at + v.size].reshape(v.shape).copy()
            at += v.size
        return Network(out)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """(step, lane, 3 * STATE) what embedded inputs give the gates, in memory with the lanes side by side."""
        out = self.w["input"].T @ x.transpose(0, 2, 1)
        out += self.w["offset"][:, None]
        return out.transpose(0, 2, 1)

    def states(self, gates: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(step, lane, STATE) states after each step, and the last one; ``trace`` gets (step, STATE, lane) parts for the gradients."""
        gates = np.ascontiguousarray(gates.transpose(0, 2, 1))
        u = np.ascontiguousarray(self.w["state"].T)
        steps, _, width = gates.shape
        kept = steps if trace is not None else 1
        before, n = (np.empty((kept, STATE, width), gates.dtype) for _ in range(2))
        zr, b = np.empty((kept, 2 * STATE, width), gates.dtype), np.empty((kept, 3 * STATE, width), gates.dtype)
        out = np.empty((steps, STATE, width), gates.dtype)
        h = h.T
        for t in range(steps):
            k = t % kept
            np.multiply(h, keep[t], out=before[k])
            np.matmul(u, before[k], out=b[k])
            # The sigmoid and the state's update, in place.
            np.add(gates[t, :2 * STATE], b[k, :2 * STATE], out=zr[k])
            np.negative(zr[k], out=zr[k])
            np.exp(zr[k], out=zr[k])
            zr[k] += 1
            np.reciprocal(zr[k], out=zr[k])
            np.multiply(zr[k, STATE:], b[k, 2 * STATE:], out=n[k])
            n[k] += gates[t, 2 * STATE:]
            np.tanh(n[k], out=n[k])
            h = np.subtract(before[k], n[k], out=out[t])
            h *= zr[k, :STATE]
            h += n[k]
        if trace is not None:
            trace.update(before=before, z=zr[:, :STATE], r=zr[:, STATE:], n=n, candidate=b[:, 2 * STATE:])
        return out.transpose(0, 2, 1), h.T.copy()

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms for rows of states and targets; with ``grads``, adds the loss's gradients and returns that of the states."""
        # Small whole numbers are sorted in linear time; a class is one slice of the sorted rows.
        order = np.argsort((target // MEMBERS).astype(np.uint16), kind="stable")
        h, target = h[order], target[order]
        cls, member = target // MEMBERS, target % MEMBERS
        edges = np.searchsorted(cls, np.arange(CLASSES + 1))
        logits = h @ self.w["class"]
        logits += self.w["class_offset"]
        logs, total = softmax_of(logits, cls)
        back = None
        if grads is not None:
            d = residual(logits, total, cls)
            grads["class"] += h.T @ d
            grads["class_offset"] += d.sum(axis=0)
            back = d @ self.w["class"].T
        for c in range(CLASSES):
            mine = slice(edges[c], edges[c + 1])
            x, own = h[mine], member[mine]
            if not len(x):
                continue
            logits = x @ self.w["member"][c]
            logits += self.w["member_offset"][c]
            part, total = softmax_of(logits, own)
            logs[mine] += part
            if grads is not None:
                d = residual(logits, total, own)
                grads["member"][c] += x.T @ d
                grads["member_offset"][c] += d.sum(axis=0)
                back[mine] += d @ self.w["member"][c].T
        return unsorted(logs, order), back if back is None else unsorted(back, order)

    def window(self, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss of a window, and the last state; nothing flows back past the window's start."""
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        x = self.w["embed"][inputs]
        trace: dict = {}
        states, last = self.states(self.gates(x), keep, h, trace)
        valid = targets >= 0
        _, back = self.log_probabilities(states[valid], targets[valid], grads)
        before, z, r, n = (trace[k] for k in ("before", "z", "r", "n"))
        # (step, STATE, lane) what a state's gradient is multiplied by on its way to each gate.
        to_z, to_r, to_n = (before - n) * z * (1 - z), trace["candidate"] * r * (1 - r), (1 - z) * (1 - n * n)
        d_states = np.zeros_like(before)
        d_states.transpose(0, 2, 1)[valid] = back
        d_gates, d_b = (np.empty((len(inputs), 3 * STATE, inputs.shape[1]), before.dtype) for _ in range(2))
        d_h = np.zeros_like(before[0])
        for t in range(len(inputs) - 1, -1, -1):
            g, e = d_gates[t], d_b[t]
            d_h += d_states[t]
            np.multiply(d_h, to_z[t], out=g[:STATE])
            np.multiply(d_h, to_n[t], out=g[2 * STATE:])
            np.multiply(g[2 * STATE:], to_r[t], out=g[STATE:2 * STATE])
            e[:2 * STATE] = g[:2 * STATE]
            np.multiply(g[2 * STATE:], r[t], out=e[2 * STATE:])
            d_h *= z[t]
            d_h += self.w["state"] @ e
            d_h *= keep[t]
        d_lanes = d_gates.transpose(0, 2, 1)
        grads["state"] += (before @ d_b.transpose(0, 2, 1)).sum(axis=0)
        grads["input"] += (x.transpose(0, 2, 1) @ d_lanes).sum(axis=0)
        grads["offset"] += d_gates.sum(axis=(0, 2))
        used = inputs.ravel()
        order = np.argsort(used.astype(np.uint16), kind="stable")
        used = used[order]
        first = np.flatnonzero(np.append(True, used[1:] != used[:-1]))
        grads["embed"][used[first]] += np.add.reduceat((d_lanes @ self.w["input"].T).reshape(-1, EMBEDDED)[order], first, axis=0)
        n = max(int(valid.sum()), 1)
        return {k: v / n for k, v in grads.items()}, last


def softmax_of(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the softmax at each row's ``own`` column, and the rows' sums; the logits become their exponentials."""
    # Without an exponential out of range there is nothing to shift by the largest.
    if len(logits) and not (logits.max() < 80 and logits.min() > -80):
        logits -= logits.max(axis=1, keepdims=True)
    picked = logits[np.arange(len(own)), own]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return picked - np.log(total), total


def residual(p: np.ndarray, total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The gradient of the loss by the logits, from what ``softmax_of`` leaves; in place."""
    p *= (1 / total)[:, None]
    p[np.arange(len(own)), own] -= 1
    return p


def unsorted(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def lanes(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step, lane) inputs, targets (-1: none), whether the state goes on, and text numbers: whole texts one after the other, the longest first into the emptiest lane."""
    own: list[list[int]] = [[] for _ in range(width)]
    heap = [(0, k) for k in range(width)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        held, k = heapq.heappop(heap)
        own[k].append(i)
        heapq.heappush(heap, (held + len(texts[i]) + 1, k))
    steps = max((h for h, _ in heap), default=0)
    inputs, targets = np.zeros((width, steps), np.int32), np.full((width, steps), -1, np.int32)
    keep, text = np.ones((width, steps), np.float32), np.zeros((width, steps), np.int32)
    for k, mine in enumerate(own):
        at = 0
        for i in mine:
            n = len(texts[i])
            keep[k, at] = 0
            inputs[k, at + 1:at + n + 1] = texts[i]
            targets[k, at:at + n] = texts[i]
            targets[k, at + n] = 0
            text[k, at:at + n + 1] = i
            at += n + 1
    return inputs.T, targets.T, keep.T, text.T


class Trainer:
    """Adam over windows of STEPS steps that run to the end of every lane, the state carried on."""

    def __init__(self, net: Network):
        self.net = Network({k: v.copy() for k, v in net.w.items()})
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
        self.steps, self.tokens = 0, 0

    def read(self, texts: list[np.ndarray], times: int = 1) -> None:
        """All tokens of the texts, their ends included, up to so many times; long texts in pieces that follow one another in no set order."""
        pieces = [t[at:at + PIECE] for t in texts for at in range(0, max(len(t), 1), PIECE)]
        ends = [at + PIECE >= len(t) for t in texts for at in range(0, max(len(t), 1), PIECE)]
        if not pieces:
            return
        total = sum(map(len, pieces)) + len(pieces)
        inputs, targets, keep, text = lanes(pieces, min(WIDEST, max(LANES, total // PIECE)))
        # Only the last piece of a text is followed by its end.
        targets[(targets == 0) & ~np.array(ends)[text]] = -1
        for _ in range(max(1, min(times, WINDOWS * STEPS // len(inputs)))):
            h = np.zeros((inputs.shape[1], STATE), np.float32)
            for at in range(0, len(inputs), STEPS):
                part = slice(at, at + STEPS)
                grads, h = self.net.window(inputs[part], targets[part], keep[part], h)
                self.step(grads)
            self.tokens += int((targets >= 0).sum())

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            m, s = self.moments[k]
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.net.w[k] = self.net.w[k] - RATE * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(s / (1 - 0.999 ** self.steps)) + 1e-8)


def symbols(index: dict[bytes, int], own: list[bytes]) -> np.ndarray:
    """Places of words in the head of the counts, -1 for others."""
    return np.fromiter(map(index.get, own, repeat(-1)), np.int32, len(own))


def as_symbols(place: np.ndarray) -> np.ndarray:
    return np.where((place >= 0) & (place < SYMBOLS - 1), place + 1, OTHER).astype(np.int32)


def fit(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Network:
    """The network after ``rounds`` of training that together read every row, averaged after each."""
    net = Network.initial(counts)
    index = {w: i for i, w in enumerate(counts.head[:SYMBOLS - 1])}
    times = max(1, -(-LEAST_TOKENS // max(counts.tokens, 1)))
    own = table_of(docs, "text")
    if not counts.tokens:
        return net
    for k in range(rounds):
        # Equal texts that are many are shared out as well.
        mine = own.select(F.monotonically_increasing_id().alias("row"), "text").where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).select("text")
        done = mine.mapInArrow(_round(net, index, times), "part int, tokens long, weights binary")
        for groups in (FAN, FAN // 8):
            done = done.groupBy(F.pmod("part", F.lit(groups)).alias("group")).applyInPandas(_summed, "part int, tokens long, weights binary")
        got = sorted(done.collect(), key=lambda r: r["part"])
        if got:
            net = net.unpacked((sum(np.frombuffer(r["weights"], np.float64) for r in got) / sum(r["tokens"] for r in got)).astype(np.float32))
    return net


def _round(net: Network, index: dict[bytes, int], times: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, tokens = Trainer(net), [], 0
        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                texts = [as_symbols(symbols(index, words(t))) for t in texts_of(part, "text")]
                held += texts
                tokens += sum(map(len, texts)) + len(texts)
                if tokens > DEALT:
                    trainer.read(held, times)
                    held, tokens = [], 0
        trainer.read(held, times)
        if trainer.tokens:
            weights = np.frombuffer(trainer.net.packed(), np.float32).astype(np.float64) * trainer.tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["part", "tokens", "weights"])

    return of


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of the weights of a group, each times its tokens."""
    ordered = pdf.sort_values("part", kind="stable")
    total = sum(np.frombuffer(w, np.float64) for w in ordered["weights"])
    return pd.DataFrame({"part": [int(ordered["part"].iloc[0])], "tokens": [int(ordered["tokens"].sum())], "weights": [total.tobytes()]})


def log_likelihoods(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each text's probability, its end included; other words as their class."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    longest = max(map(len, texts)) + 1
    width = max(1, min(MOST_LANES, sum(len(t) + 1 for t in texts) // longest))
    inputs, targets, keep, text = lanes(texts, width)
    h = np.zeros((width, STATE), np.float32)
    for at in range(0, len(inputs), LONG_STEPS):
        part = slice(at, at + LONG_STEPS)
        states, h = net.states(net.gates(net.w["embed"][inputs[part]]), keep[part], h)
        valid = targets[part] >= 0
        logs, _ = net.log_probabilities(states[valid], targets[part][valid])
        out += np.bincount(text[part][valid], weights=logs, minlength=len(texts))
    return out


def first_pass(docs: DataFrame, counts: Counts, net: Network) -> DataFrame:
    """Per row: what the network and the head of the counts give, and the words whose counts are still to be joined."""
    index = {w: i for i, w in enumerate(counts.head)}
    logs = np.append(np.log10(counts.head_counts + 1.0), 0.0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            model = log_likelihoods(net, [s for _, ss, *_ in held for s in ss]) / math.log(10)
            at = 0
            for part, ss, places, rest in held:
                base = [float(logs[p].sum()) for p in places]
                other = [float(logs[p[p >= SYMBOLS - 1]].sum()) for p in places]
                flat = [w for r in rest for w in r]
                sizes = np.cumsum([0] + [len(r) for r in rest])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(flat, pa.binary()), pa.array([n for r in rest for n in r.values()], pa.int64())], ["word", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array([len(p) + 1 for p in places], pa.int64()), pa.array([int((p >= 0).sum()) for p in places], pa.int64()),
                     pa.array([int((s == OTHER).sum()) for s in ss], pa.int64()), pa.array(base), pa.array(other), pa.array(model[at:at + len(ss)]), lists],
                    ["row", "doc_id", "n_tokens", "n_head", "n_other", "base", "other", "model", "rest"])
                at += len(ss)
            held.clear()

        for batch in batches:
            for part in chunks_of(batch, "text", SLICE):
                texts = [words(t) for t in texts_of(part, "text")]
                places = [symbols(index, own) for own in texts]
                rest = [Counter(own[k] for k in np.flatnonzero(p < 0).tolist()) for own, p in zip(texts, places)]
                held.append((part, [as_symbols(p) for p in places], places, rest))
                tokens += sum(map(len, places))
                if tokens > TOGETHER:
                    yield from flush()
                    tokens = 0
        yield from flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = table_of(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(of, (
        f"row long, doc_id {kind}, n_tokens long, n_head long, n_other long, base double, other double, model double, rest array<struct<word: binary, n: long>>"))


def scored(docs: DataFrame, learn: Column, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    ``learn`` is a condition on doc_id of the rows that counts and weights come
    from; where it is null, the row teaches nothing and held_out is true. Null
    texts are empty: one token, the end. Repeated rows count as often as they
    are there. Without a row to learn from all tokens are unknown. No row gives no row.
    """
    known = F.coalesce(learn, F.lit(False))
    train = docs.where(known)
    counts = settled(word_counts(train), "counts")
    totals = gathered(counts)
    net = fit(train, totals, rounds)
    first = settled(first_pass(docs, totals, net), "scored")
    rest = first.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    joined = rest.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("rest_log"), F.sum("times").alias("rest_known"))
    out = first.drop("rest").join(joined, "row", "left").fillna(0, ["rest_log", "rest_known"])
    end = math.log10(totals.texts + 1)
    n_other, v_other = totals.other
    return out.select(
        "doc_id", (~known).alias("held_out"), "n_tokens", (F.col("n_head") + F.col("rest_known") + F.lit(int(totals.texts > 0))).cast("long").alias("n_known"),
        F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest_log") + end - F.col("n_tokens") * math.log10(totals.unit)).alias("base_score"),
        (F.col("model") + F.col("other") + F.col("rest_log") - F.col("n_other") * math.log10(n_other + v_other + 1)).alias("score"))
