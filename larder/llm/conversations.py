"""Repair of conversations whose turns are damaged: the cheapest edits that make the roles alternate.

Rows are dealt by conversation and sorted by Spark; a task reads its partition as
a stream and holds one conversation at a time. A conversation is the unit: its
repaired text has one hash, which is read from front to end. Rows that are equal
in all columns travel as one row with a count, so a row repeated without end
costs no more than one.

The search is iterative-deepening A*. A state is the number of rows used and the
last role given; edits are tried in the order of their initials, so the first
path accepted under the least bound is the cheapest and, of equally cheap ones,
the least as text. States that failed are remembered with the budget they had.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import table_of

DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\v\f\r"
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")

# States of the pattern (s?(ua)+)? by the last role given.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}


def damage_of(conv_id: Column, turn: Column) -> Column:
    """The kind of damage, 0 to 19, that the key of a row brings on it."""
    text = [F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv_id, turn)]
    return F.crc32(F.concat_ws(":", *text).cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows dropped (n is 0), emptied, stripped of sentence ends, repeated (n is 2) or given to the user.

    Null roles and texts read as one space.
    """
    rows = table_of(conversations, "conv_id", "turn", "role", "text")
    kind = damage_of(F.col("conv_id"), F.col("turn"))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def wanted(state: int) -> str:
    """The role that may be inserted or given next."""
    return "a" if state == USER else "u"


def fits(state: int, role: str) -> bool:
    return role == wanted(state) or (role == "s" and state == START)


class Search:
    """The cheapest edits of rows that may stay; ``roles`` are their initials, ``cut`` says which texts end without a sentence end."""

    def __init__(self, roles: list[str], cut: list[bool]):
        self.roles, self.cut, self.n = roles, cut, len(roles)
        self.ends = [0] * (self.n + 1)
        self.clashes = [0] * (self.n + 2)
        for k in range(self.n - 1, -1, -1):
            self.ends[k] = self.ends[k + 1] + CUT_SHORT * cut[k]
            last = k + 1 == self.n
            legal = roles[k] == "a" if last else roles[k] + roles[k + 1] in LEGAL
            # Deleting a row whose text is cut short costs one more than keeping it.
            least = 0 if legal else DELETE - CUT_SHORT if cut[k] or not last and cut[k + 1] else INSERT
            self.clashes[k] = max(self.clashes[k + 1], least + self.clashes[min(k + 2, self.n)])

    def least(self, k: int, state: int) -> int:
        """What rows from ``k`` on cost at least: texts cut short, and one edit for each of the neighbours that clash and share no row."""
        if k == self.n:
            return {SYSTEM: 2 * INSERT, USER: INSERT}.get(state, 0)
        first = 0 if fits(state, self.roles[k]) else DELETE - CUT_SHORT if self.cut[k] else INSERT
        return self.ends[k] + max(self.clashes[k], first + self.clashes[k + 1])

    def moves(self, k: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, cost, next row, next state) in ASCII order."""
        given = AFTER[wanted(state)]
        if k == self.n:
            return [("I", INSERT, k, given)]
        more = CUT_SHORT * self.cut[k]
        out = [("D", DELETE, k + 1, state), ("I", INSERT, k, given)]
        if fits(state, self.roles[k]):
            out.append(("K", more, k + 1, AFTER[self.roles[k]]))
        out.append(("R", REROLE + more, k + 1, given))
        return out

    def run(self) -> tuple[int, list[tuple[str, int]]]:
        """(cost, the edits as (initial, row))."""
        bound, failed = self.least(0, START), {}
        while True:
            beyond, path = None, [(0, START, 0, "", iter(self.moves(0, START)))]
            while path:
                k, state, spent, _, rest = path[-1]
                if k == self.n and state in (START, ASSISTANT):
                    return spent, [(p[3], q[0]) for q, p in zip(path, path[1:])]
                for initial, cost, to, after in rest:
                    total = spent + cost
                    reach = total + self.least(to, after)
                    if reach > bound:
                        beyond = reach if beyond is None else min(beyond, reach)
                    elif failed.get((to, after), -1) < bound - total:
                        path.append((to, after, total, initial, iter(self.moves(to, after))))
                        break
                else:
                    failed[k, state] = max(failed.get((k, state), -1), bound - spent)
                    path.pop()
            bound = beyond


def repaired(rows: list[tuple]) -> dict:
    """Faults, edits and the hash of the repaired rows; ``rows`` are (turn, role, text, n) in order, n equal rows in a place."""
    seen, counts, illegal, before = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
    stay, dropped, cut = [], [0], []
    turns = {t for t, *_, n in rows if t is not None and n}
    for _, role, text, n in rows:
        if not n:
            continue
        pairs = [(before, role[:1])] * (before is not None) + [(role[:1], role[:1])] * (n > 1)
        illegal += sum((n - 1 if x == y and i == len(pairs) - 1 and n > 1 else 1) for i, (x, y) in enumerate(pairs) if x + y not in LEGAL)
        before = role[:1]
        bare = text.rstrip(BLANKS)
        known = (role, text) in seen
        seen.add((role, text))
        if not bare:
            counts["blank"] += n
            dropped[-1] += n
            continue
        again = n if known else n - 1
        counts["duplicate"] += again
        if not known:
            ends = bare[-1] not in ".!?"
            counts["truncated"] += ends
            stay.append((role, text))
            cut.append(ends)
            dropped.append(0)
        dropped[-1] += again
    search = Search([r[:1] for r, _ in stay], cut)
    cost, edits = search.run()
    # Rows that must go are deleted at once: D is the least initial.
    audit, digest, lines, state, at = ["D" * dropped[0]], hashlib.sha256(), 0, START, 0
    for initial, k in edits:
        given = None
        if initial == "K":
            given, line = stay[k][0][:1], ":".join(stay[k])
        elif initial in "RI":
            given = wanted(state)
            line = f"{NAMES[given]}:{stay[k][1] if initial == 'R' else ''}"
        if given:
            digest.update(("\n" * bool(lines) + line).encode())
            lines, state = lines + 1, AFTER[given]
        audit.append(initial)
        if initial != "I":
            at = k + 1
            audit.append("D" * dropped[at])
    return counts | {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "illegal": illegal,
        "cost": cost + DELETE * sum(dropped), "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def repaired_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by conversation, turn, role and text -> a row per conversation."""
    schema = pa.schema([(n.split()[0], pa.string() if n.endswith("string") else pa.int64()) for n in SCHEMA.split(", ")])
    key, rows, out = None, [], []
    for batch in batches:
        for conv_id, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n"))):
            if rows and conv_id != key:
                out.append({"conv_id": key} | repaired(rows))
                rows = []
            key = conv_id
            rows.append(row)
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if rows:
        out.append({"conv_id": key} | repaired(rows))
    yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the cheapest edits and the hash of what they leave.

    ``rows`` are (conv_id, turn, role, text, n), n times each; a row with n = 0
    only says that the conversation exists. Rows stand by turn, nulls first, those
    of one turn by role and text. The rows of a null conv_id are one conversation.
    A role counts by its first character; empty and other roles fit nowhere. A
    conversation without rows has zeros, an empty audit and the hash of the empty
    text; an empty table gives none.
    """
    keys = ["conv_id", "turn", "role", "text"]
    return (
        rows.groupBy(*keys).agg(F.sum("n").alias("n"))
        .repartition("conv_id").sortWithinPartitions(*keys)
        .mapInArrow(repaired_batches, SCHEMA)
    )
