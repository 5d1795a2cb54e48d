"""The interval join against all pairs: any mix of lengths, any cell, any number of sweeps."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmurlake.functions.intervals import interval_join, interval_totals, overlapping, totals
from murmurlake.operators import timeline as t

TIMES = st.lists(st.tuples(st.integers(0, 2), st.integers(-30, 90), st.sampled_from([0, 1, 3, 10, 200])), max_size=25)


def placed(rows, cell):
    """(key, start, length) as the join deals them: a row for each cell."""
    out = [(key, c, s, s + n, i) for i, (key, s, n) in enumerate(rows) for c in range(s // cell, max(s, s + n - 1) // cell + 1)]
    key, c, s, e, of = (np.array([r[k] for r in out], np.int64) for k in range(5))
    return (key * 1_000_003 + c, c, s, e), of


@settings(max_examples=300, deadline=None)
@given(TIMES, TIMES, st.sampled_from([1, 2, 7, 50, 1000]))
def test_each_overlapping_pair_once(a, b, cell):
    (x, of_x), (y, of_y) = placed(a, cell), placed(b, cell)
    i, j = overlapping(x, y, cell)
    want = sorted((p, q) for p, (k, s, n) in enumerate(a) for q, (m, r, d) in enumerate(b) if k == m and s < r + d and s + n > r)
    assert sorted(zip(of_x[i].tolist(), of_y[j].tolist(), strict=True)) == want


@pytest.mark.parametrize(("cell", "rows"), [(None, 100_000), (None, 300), (10, 500), (100_000, 100_000)])
def test_one_recording_holds_nearly_all(spark, cell, rows):
    """A skewed recording with a few turns as long as itself; null keys and times meet nothing."""
    rng = np.random.default_rng(5)
    words = [(None if i == 7 else 1 if i % 20 else 2, i, int(s), None if i == 9 else int(s) + 30, f"w{i}") for i, s in enumerate(rng.integers(0, 50_000, 700))]
    turns = [(1 if i % 15 else 2, f"s{i % 4}", int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 50_000, 300), rng.choice([5, 60, 900, 60_000], 300, p=[0.5, 0.3, 0.17, 0.03]), strict=True))]
    a = spark.createDataFrame(words, "rec long, word_id long, start_ms long, end_ms long, text string")
    b = spark.createDataFrame(turns, "rec long, speaker string, r_start long, r_end long")
    got = interval_join(a, b, ["rec"], cell, rows)
    assert got.columns == ["rec", "word_id", "start_ms", "end_ms", "text", "speaker", "r_start", "r_end"]
    want = sorted((w[0], w[1], w[2], w[3], w[4], *u[1:]) for w in words if w[3] is not None for u in turns if w[0] == u[0] and w[2] < u[3] and w[3] > u[2])
    assert sorted(map(tuple, got.collect())) == want


def test_nothing_to_join(spark):
    none = spark.createDataFrame([], "rec long, word_id long, start_ms long, end_ms long, text string")
    turns = spark.createDataFrame([(1, "s", 0, 5, 0.5)], "rec long, speaker string, start_ms long, end_ms long, conf double")
    assert t.attribute_words(none, turns).collect() == []
    words = spark.createDataFrame([(1, 1, 9, 12, "x"), (3, 2, 0, 4, "y")], "rec long, word_id long, start_ms long, end_ms long, text string")
    got = {r.word_id: (r.speaker, r.active, r.confidence) for r in t.attribute_words(words, turns).collect()}
    assert got == {1: (None, [], 0.0), 2: (None, [], 0.0)}


def test_rows_cross_the_shuffle_about_twice(spark):
    """Mean-length cells: two copies a row on average, even where a few intervals are a thousand times longer than most."""
    rng = np.random.default_rng(1)
    length = np.where(rng.random(5000) < 0.01, 100_000, 10)
    start = rng.integers(0, 10_000_000, 5000)
    cell = int(np.ceil(length.mean()))
    assert ((np.maximum(start, start + length - 1) // cell) - start // cell + 1).mean() <= 2.01


@settings(max_examples=300, deadline=None)
@given(TIMES, TIMES, st.sampled_from([1, 2, 7, 50, 1000]))
def test_totals_are_those_of_all_pairs(a, b, cell):
    (x, of_x), (y, of_y) = placed(a, cell), placed(b, cell)
    by, value = np.array([i * 7 % 3 for i in range(len(b))], np.int64), np.array([i * 5 % 11 for i in range(len(b))], float)
    lines = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)[1]
    found = {}
    for i, k, ms, top in zip(*totals(lines[: len(of_x)], x[2] - x[1] * cell, x[3] - x[1] * cell, lines[len(of_x) :], by[of_y], y[2] - y[1] * cell, y[3] - y[1] * cell, value[of_y], cell), strict=True):
        was = found.get((of_x[i], k), (0, -1))
        found[of_x[i], k] = was[0] + ms, max(was[1], top)
    want = {}
    for p, (k, s, n) in enumerate(a):
        for q, (m, r, d) in enumerate(b):
            if k == m and s < r + d and s + n > r:
                was = want.get((p, by[q]), (0, -1))
                want[p, by[q]] = was[0] + max(0, min(s + n, r + d) - max(s, r)), max(was[1], value[q])
    assert found == want


def test_words_under_many_turns_make_no_pairs(spark, monkeypatch):
    """1,500 words that each lie in 1,500 turns of four speakers: a row for each word and speaker, for map_slots too."""
    monkeypatch.setattr(t, "interval_join", None)
    words = spark.range(1500).selectExpr("id % 2 AS rec", "id AS word_id", "'w' AS text", "id AS start_ms", "id + 2 AS end_ms")
    turns = spark.range(3000).selectExpr("id % 2 AS rec", "concat('speaker_', id % 4) AS speaker", "-id AS start_ms", "id + 5000 AS end_ms", "id / 3000D AS conf")
    right = turns.selectExpr("rec", "speaker", "conf", "start_ms AS r_start", "end_ms AS r_end")
    assert interval_totals(words, right, ["rec"], "speaker", "conf").count() < 2 * 2 * 1500
    got = t.attribute_words(words, turns).collect()
    assert {(r.rec, r.speaker, tuple(r.active), round(r.confidence, 6)) for r in got} == {(0, "speaker_0", ("speaker_0", "speaker_2"), round(2996 / 6000, 6)), (1, "speaker_1", ("speaker_1", "speaker_3"), round(2997 / 6000, 6))}
    slots = t.map_slots(words.selectExpr("rec", "word_id AS track", "CAST(word_id % 4 AS INT) AS slot", "start_ms", "end_ms"), turns).groupBy("slot", "speaker").count().collect()
    assert {(r.slot, r.speaker) for r in slots} == {(k, f"speaker_{k}") for k in range(4)}
