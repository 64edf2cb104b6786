"""Damage and repair of conversations against a shortest-path search of its own."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from larder.llm import conversations
from larder.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, turn long, role string, text string, n int, audit string, cost long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def shortest(rows):
    """(cost, audit, lines) by Dijkstra over all edits, least audit first among equal costs."""
    marks = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        following = {"": "us", "s": "u", "u": "a", "a": "u"}[last]
        for role in ("user", "assistant"):
            if role[0] in following:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if marks[i] in ("blank", "duplicate"):
                continue
            more = 3 * (marks[i] == "truncated")
            if role[:1] and role[:1] in following:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if new[0] in following:
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))


def expected(rows):
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    out = {}
    for conv, own in by_id.items():
        own = after_damage(own)
        marks, turns = faults(own), {t for t, *_ in own if t is not None}
        cost, audit, lines = shortest(own)
        roles = [r[:1] for _, r, _ in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def made_up(seed, conversations_of=150):
    rng, out = random.Random(seed), []
    for conv in range(conversations_of):
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "ua"][: rng.choice([5, 8])])
            text = rng.choice(["Yes.", "No!", "open end", "", " \n", "Sure?  ", "é", "A.\x0b", f"text {turn}."])
            out.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text))
    return out


def test_tables_by_shortest_paths(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op13_conversations"](spark, SF)) == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_made_up_conversations(spark, seed):
    rows = made_up(seed)
    assert result(conversations.repair(conversations.damaged(frame(spark, rows)))) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (1, None, "user", None), (2, 5, None, "x."), (3, 2, "a", "b " * 100_000)]
    rows += [(4, 0, "user", "same.")] * 50 + [(5, t, "assistant", f"no {t}") for t in range(3)]
    dropped = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "Gone."), (6, 2 ** 40, "user", "far."), (6, 0, "assistant", "near.")]
    got = result(conversations.repair(conversations.damaged(frame(spark, rows))))
    assert got == expected(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", EMPTY)


def test_empty_table(spark):
    assert conversations.repair(conversations.damaged(frame(spark, []).where("false"))).collect() == []


def test_long_conversation_and_repeats(spark):
    rng = random.Random(5)
    rows = [(9, t, rng.choice(["user", "assistant"]), rng.choice(["Fine.", f"turn {t}.", f"open {t}"])) for t in range(1500)]
    assert result(conversations.repair(conversations.damaged(frame(spark, rows)))) == expected(rows)
    many = frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]).selectExpr("conv_id", "turn", "role", "text", "1000000L n")
    got = conversations.repair(many).collect()[0]
    assert (got["cost"], got["duplicate"], len(got["audit"]), got["illegal"]) == (4 * 1_999_998, 1_999_998, 2_000_000, 1_999_998)


def test_bounds_rise_and_never_exceed_the_cost():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice([f"a{t}.", f"b{t}"])) for t in range(rng.randint(0, 9))]
        search = conversations.Search([r[1][0] for r in rows], [not r[2].endswith(".") for r in rows])
        cost, audit, _ = shortest(rows)
        assert search.least(0, conversations.START) <= cost
        assert search.run()[0] == cost and "".join(e for e, _ in search.run()[1]) == audit
