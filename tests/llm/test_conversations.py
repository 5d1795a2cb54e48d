"""op12 against SQL and against a search over all edits, whatever the ranges that turns are dealt to."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from oracle import answer, rows
from pyspark.sql import functions as F

from murmurlake.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, n long, part string, audit int"
SPACE = " \t\n\x0b\x0c\r"


def hurt(given):
    """The damage, row by row."""
    out = []
    for conv, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = {1: ""}.get(k, re.sub("[.!?]", "", text) if k == 2 else text), "user" if k == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def searched(turns):
    """cost, audit, repaired of the cheapest and ASCII-least edits: best first over (cost, audit), by what has been made so far."""
    seen, faults = set(), []
    for role, text in turns:
        body = text.rstrip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = lambda m: re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or "?" for r in m))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        roles = "".join(r.split(":")[0][:1] or "?" for r in made)
        if (i, state := (len(roles) > 0, roles[-1:])) in done:
            continue
        done.add((i, state))
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return faults, cost, audit, "\n".join(made)
        ways = [(5, "I", i, made + (f"{r}:",)) for r in ("user", "assistant")]
        if i < len(turns):
            (role, text), f = turns[i], faults[i]
            more = 5 * (f == "truncated")
            ways.append((2, "D", i + 1, made))
            if f not in ("blank", "duplicate"):
                ways += [(more, "K", i + 1, made + (f"{role}:{text}",)), *((1 + more, "R", i + 1, made + (f"{r}:{text}",)) for r in ("user", "assistant"))]
        for c, letter, j, m in ways:
            if fits(tuple(x.split(":")[0] for x in m)):
                heapq.heappush(heap, (cost + c, audit + letter, j, m))


def expected(given):
    out = []
    left = hurt(given)
    for conv in {r[0] for r in given}:
        own = [r for r in left if r[0] == conv]
        numbers = [r[1] for r in own if r[1] is not None]
        faults, cost, audit, made = searched([r[2:] for r in own])
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(made.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", *cv.COUNTS, "audit", "repaired_sha256").collect()), key=str)


def made_up(seed, n):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "sage", "ä"], ["Well.", "Yes!", "no end", "", " \t", None, "Why?\n", "ok. ", "x" * 3000 + "."]
    out = []
    for conv in [None, *range(n)]:
        for t in range(rng.choice([1, 2, 5, 9, 40])):
            out.append((conv, rng.choice([t, t, t, None, t // 2]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.6 else f"Turn {t}."))
    return out


@pytest.mark.parametrize("ranges", [1, 7, 61])
def test_against_search(spark, ranges):
    """Conversations of one turn up to forty, in one range and cut into dozens of chunks; null ids, roles, texts and turns."""
    given = made_up(ranges, 40)
    d = spark.createDataFrame([(*r, 9, "x", 1) for r in given], SCHEMA)
    assert got(cv.repair(cv.damaged(d), ranges)) == expected(given)


@pytest.mark.parametrize("ranges", [1, 40])
def test_one_long_conversation(spark, ranges):
    """One conversation holds nearly all rows: chunks converge to the answer of one chain, and turns repeated across chunks are found."""
    rng = random.Random(5)
    given = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Line {t}.", f"Line {t % 50}.", "cut off"])) for t in range(1500)] + [(2, 0, "user", "Hello?")]
    d = spark.createDataFrame([(*r, 9, "x", 1) for r in given], SCHEMA)
    turns = [r for r in hurt(given) if r[0] == 1]
    chunk = cv.Chunk((t, r, x, 1, False) for _, t, r, x in turns)
    edits, state, cost = cv.traced(chunk.codes, cv.AT_END, cv.START)
    found = {r[0]: r for r in got(cv.repair(cv.damaged(d), ranges))}
    made = cv.repaired(chunk.turns, edits, cv.START) + cv._inserted(state)
    assert found[1][6:] == (cost + cv.AT_END[state], "".join(edits) + cv.LAST[state], hashlib.sha256("\n".join(made).encode()).hexdigest())
    assert found[1][2:6] == (chunk.blank, chunk.duplicate, chunk.truncated, chunk.illegal)


def test_fixed_up_is_a_rerun():
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(30)))
        was, right = (tuple(rng.randrange(6) for _ in range(4)) for _ in range(2))
        a, b = (tuple(x - min(v) for x in v) for v in (was, right))
        assert cv.fixed_up(codes, a, cv.backward(codes, a), b) == cv.backward(codes, b)


def test_equal_rows_and_none(spark):
    many = spark.createDataFrame([(1, 3, "user", "Same.", 0, "", 0)] * 50 + [(1, 4, "assistant", "Yes.", 0, "", 0)], SCHEMA)
    assert got(cv.repair(cv.damaged(many), 5)) == expected([(1, 3, "user", "Same.")] * 50 + [(1, 4, "assistant", "Yes.")])
    assert got(cv.repair(cv.damaged(many.limit(0)))) == []


def test_sql(spark, sf):
    want = answer(cv.SQL, sf)
    for ranges in (None, 9):
        have = cv.repair(cv.damaged(spark.read.parquet(f"{sf}/conversations.parquet")), ranges).toPandas()
        assert rows(have[sorted(have.columns)]) == rows(want)
    given = made_up(99, 30)
    d = spark.createDataFrame([(*r, 9, "x", 1) for r in given], SCHEMA)
    want = answer(cv.SQL, sf, conversations=d.select("conv_id", F.col("turn"), "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert rows(cv.repair(cv.damaged(d), 4).toPandas()) == rows(want)
