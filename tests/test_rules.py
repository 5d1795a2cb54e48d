"""Operators against their rules over whole signals, words and groups, written plainly."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmurlake.operators import bench, models, signals, spectral, text


def blocks(spark, x, size, rec=1, channel=None):
    rows = [(rec, *(() if channel is None else (channel,)), k, k * size, [float(v) for v in x[k * size : (k + 1) * size]]) for k in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, f"rec long, {'' if channel is None else 'channel int, '}block_idx long, start_frame long, samples array<double>")


def flat(df):
    return np.array([x for r in df.orderBy("start_frame").collect() for x in r["samples"]])


def trimmed(x, top_db, frame, hop):
    """From the first loud frame's hop to the last one's hop and a frame, over mirrored ends."""
    half, n = frame // 2, len(x)
    if n <= 1 or n <= half:
        return 0, n
    y = np.concatenate([x[1 : half + 1][::-1], x, x[-2 : -half - 2 : -1]])
    db = [20 * math.log10(max(math.sqrt((y[i * hop : i * hop + frame] ** 2).mean()), 1e-10)) for i in range((len(y) - frame) // hop + 1)]
    loud = [i for i, v in enumerate(db) if v > max(db) - top_db]
    lo, hi = loud[0] * hop, min(n, loud[-1] * hop + frame)
    return (lo, hi) if hi > lo else (0, n)


def test_silence_trim(spark):
    tone = np.zeros(20_000)
    tone[6000:9000] = np.sin(np.arange(3000) / 3)
    r = signals.trim_silence(blocks(spark, tone, 4096)).first()
    assert (r["lo"], r["hi"]) == (5120, 11776)
    rng = np.random.default_rng(0)
    cases = {0: np.zeros(300), 1: np.ones(1), 2: np.ones(32), 3: np.ones(33), 10: np.concatenate([np.zeros(255), [5.0]]), 11: np.concatenate([np.zeros(256), [5.0]])}
    for n in (34, 63, 64, 65, 127, 128, 129, 257, 500):
        cases[n] = rng.normal(size=n) * 10.0 ** -rng.integers(0, 6, -(-n // 40)).repeat(40)[:n]
    rows = [(rec, k, k * 50, [float(v) for v in x[k * 50 : k * 50 + 50]]) for rec, x in cases.items() for k in range(-(-len(x) // 50))]
    d = spark.createDataFrame(rows, "rec long, block_idx long, start_frame long, samples array<double>").coalesce(4)
    for size in (16, 4096):
        got = {r["rec"]: (r["lo"], r["hi"]) for r in signals.trim_silence(d, 30, 64, 16, size).collect()}
        assert got == {rec: trimmed(x, 30, 64, 16) for rec, x in cases.items()}


def test_inverse_by_window_sum(spark):
    """n_fft 16, hop 5: frames added up over the summed windows, with and without centring, whatever the block."""
    x = np.random.default_rng(1).uniform(-1, 1, 203)
    w, v = spectral.window_of("hann", 16), spectral.window_of("hann", 17)[:16]
    for center in (True, False):
        y = np.concatenate([x[1:9][::-1], x, x[-2:-10:-1]]) if center else x
        n = (len(y) - 16) // 5 + 1
        out, by = np.zeros((n - 1) * 5 + 16), np.zeros((n - 1) * 5 + 16)
        for i in range(n):
            out[i * 5 : i * 5 + 16] += y[i * 5 : i * 5 + 16] * w * v
            by[i * 5 : i * 5 + 16] += v
        want = np.where(by != 0, out / np.where(by != 0, by, 1), out)[8:-8] if center else np.where(by != 0, out / np.where(by != 0, by, 1), out)
        for size, block in ((40, 3), (1000, 64)):
            s = spectral.stft(blocks(spark, x, 30), 16, 5, size=size, center=center)
            got = flat(spectral.istft(s, spectral.n_frames(s, 16, 5, center), 16, 5, block=block, norm="sum", center=center))
            assert np.allclose(got, want, atol=1e-9)


def test_windows_and_filters(spark):
    assert spectral.window_of([1.0, 2.0], 4).tolist() == [1, 2, 0, 0] and np.allclose(spectral.window_of("hann", 6), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(6) / 6))
    a, b, c, d = (spectral.mel_filters(16000, 512, 10, scale=s, norm=n) for s in ("slaney", "htk") for n in ("slaney", None))
    assert np.allclose((a * 16000 / 512).sum(axis=1)[3:], 1, atol=0.05) and not np.allclose(a, b) and c.max() < 0.1 < 0.9 < d.max()
    assert np.allclose(spectral.mel_filters(16000, 512, 10), a) and np.allclose(spectral.mel_filters(16000, 512, 10, scale="htk"), d)
    x = np.random.default_rng(4).normal(size=100)
    short = spectral.stft(blocks(spark, x, 32), 16, 4, center=False, win_length=10, size=20).orderBy("frame").collect()
    w = np.concatenate([spectral.window_of("hann", 10), np.zeros(6)])
    want = [np.fft.rfft(x[i : i + 16] * w) for i in range(0, 85, 4)]
    assert len(short) == len(want) and all(np.allclose(r["bins"], np.concatenate([z.real, z.imag])) for r, z in zip(short, want))


@pytest.mark.parametrize("n", [3, 5, 6, 48, 49, 200, 301, 302, 303])
def test_mirrored_fbank(spark, n):
    """Hops of 6, frames of 16: (n + 3) // 6 frames over ends mirrored as far as these reach, whatever the block."""
    x = np.random.default_rng(n).normal(size=n)
    y = np.concatenate([x[1:6][::-1], x, x[-2:-12:-1]]) if n > 5 else np.concatenate([np.zeros(5), x, np.zeros(20)])
    rows = spectral.kaldi_fbank(blocks(spark, x, 100), 640, 4, snip_edges=False).orderBy("frame").collect()
    assert [r["frame"] for r in rows] == list(range((n + 3) // 6))
    w, m = spectral.WINDOWS["povey"](16), spectral.mel_filters(640, 16, 4, 20.0, scale="htk")
    for r in rows:
        f = y[r["frame"] * 6 : r["frame"] * 6 + 16]
        f = f - f.mean()
        f = np.concatenate([[f[0] * 0.03], f[1:] - 0.97 * f[:-1]]) * w
        assert np.allclose(r["bins"], np.log(np.maximum(np.abs(np.fft.rfft(f, 16)) ** 2 @ m.T, np.finfo(np.float32).eps)))


@pytest.mark.parametrize(("rate", "to"), [(48000, 16000), (44100, 16000), (16000, 44100)])
def test_band_limited_resampling(spark, rate, to):
    """A tone over the new limit is under a tenth of what cubic leaves; one within stays, in place and as loud."""
    n = rate // 4
    t = np.arange(n) / rate
    energy = lambda x, hz: abs((x * np.exp(-2j * np.pi * hz * np.arange(len(x)) / to)).sum()) / len(x)
    low = np.sin(2 * np.pi * 440 * t)
    y = flat(signals.resample(blocks(spark, low, 5000), rate, to, "high", 4000))
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / to)
    assert len(y) == n * to // rate and np.abs(y[200:-200] - want[200:-200]).max() < 0.01
    shift = [float(np.dot(y[300:-300], want[300 + k : len(want) - 300 + k])) for k in (-1, 0, 1)]
    assert max(shift) == shift[1]
    whole = flat(signals.resample(blocks(spark, low, n), rate, to, "high", 10**6))
    assert np.allclose(y, whole, atol=1e-12)
    if to < rate:
        tone = 0.5 * np.sin(2 * np.pi * 15000 * t)
        cubic, high = (flat(signals.resample(blocks(spark, tone, 5000), rate, to, m, 4000)) for m in ("balanced", "high"))
        assert energy(high, 1000) < energy(cubic, 1000) / 10 and energy(cubic, 1000) > 0.05


def test_adapt_any_pairs_in_one_pass(spark):
    """Twelve recordings, twelve pairs of rates, one to three channels: as if each were converted alone, and one resampling in the plan."""
    rng = np.random.default_rng(9)
    rates, need, rows = [8000, 11025, 16000, 22050], [], []
    alone = {}
    for rec in range(12):
        have, rate, to, want = rec % 3 + 1, rates[rec % 4], rates[(rec * 5 + 1) % 4], rec % 2 + 1
        x = rng.normal(size=(have, 400))
        rows += [(rec, c, k, k * 90, x[c, k * 90 : k * 90 + 90].tolist(), rate) for c in range(have) for k in range(5)]
        planes = x if have == want else np.repeat(x.mean(axis=0)[None], want, axis=0)
        for c in range(want):
            alone[rec, c] = planes[c] if rate == to else signals.resampled(planes[c], 0, 0, 400, 400, rate, to, "auto")[1]
        need.append((rec, to, want))
    d = spark.createDataFrame(rows, "rec long, channel int, block_idx long, start_frame long, samples array<double>, sample_rate int")
    got = models.adapt(d, spark.createDataFrame(need, "rec long, rate int, channels int"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    rows = got.collect()
    assert {(r["rec"], r["channel"]) for r in rows} == set(alone) and {(r["rec"], r["sample_rate"]) for r in rows} == {(a, b) for a, b, _ in need}
    for (rec, c), want in alone.items():
        y = np.concatenate([r["samples"] for r in sorted(rows, key=lambda r: r["start_frame"]) if (r["rec"], r["channel"]) == (rec, c)])
        assert np.allclose(y, want, atol=1e-9), (rec, c)


def longest_first(word, vocab, unknown="[UNK]"):
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        size = next((n for n in range(len(word) - at, 0, -1) if mark + word[at : at + n] in vocab), 0)
        out.append(mark + word[at : at + size] if size else unknown)
        at += size or 1
    return out


LETTERS = st.text("ab#c", max_size=6)


@settings(max_examples=400, deadline=None)
@given(st.sets(st.one_of(LETTERS, LETTERS.map("##".__add__)), max_size=14), st.lists(st.text("ab#cd", max_size=18), max_size=8))
def test_word_pieces_are_the_longest_from_the_left(vocab, words):
    cut = text.WordPieces(vocab)
    for w in words:
        assert cut(w) == longest_first(w, vocab)


def test_word_pieces_of_all_documents(sf):
    """The words of documents, and pieces that are cut out of them; a long word costs its length."""
    words = sorted({w for t in pd.read_parquet(f"{sf}/documents.parquet")["text"] if t for w in t.lower().split()})
    rng = random.Random(1)
    vocab = {w[: rng.randrange(1, 6)] for w in words[::3]} | {"##" + w[rng.randrange(0, 3) :][: rng.randrange(1, 5)] for w in words[::2]}
    cut = text.WordPieces(vocab)
    assert all(cut(w) == (longest_first(w, vocab) if len(w) <= 100 else ["[UNK]"]) for w in words)
    hard = text.WordPieces(["a" * n for n in (1, 60)] + ["##" + "a" * n for n in (1, 60)] + ["##" + "a" * 61 + "b"], longest=10**6)
    assert hard("a" * 300) == ["a" * 60, *["##" + "a" * 60] * 4] and len(hard("a" * 200_000)) > 3000


@pytest.mark.parametrize("hold", [3, 10**6])
def test_exact_median(spark, hold):
    rng = np.random.default_rng(3)
    inf, nan = float("inf"), float("nan")
    groups = {"one": [2.5], "two": [1.0, 4.0], "ties": [3.0] * 40, "odd": rng.normal(size=101).tolist(), "even": rng.exponential(size=90).tolist(), "wide": [10.0**k for k in range(-60, 60, 5)], "signs": [-1e308, 1e308, 5.0], "ends": [-inf, -inf, 1.0, inf], "nan": [1.0, nan, nan], "most": [1.0] * 30 + [2.0] * 31, "inf": [inf, inf], "mixed": [-inf, 3.0, 7.0, nan]}
    d = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)], "k string, v double")
    got = {r["k"]: r["median"] for r in bench.exact_median(d, "k", "v", hold, 256).collect()}
    want = {r["k"]: r["m"] for r in d.where("v IS NOT NULL").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert set(got) == set(want)
    for k in want:
        assert (math.isnan(got[k]) and math.isnan(want[k])) or got[k] == pytest.approx(want[k], rel=1e-12, abs=0), k
    runs = d.where("k IN ('odd', 'even', 'ties')").select(F.col("k").alias("case_id"), F.abs("v").alias("seconds"), F.lit(30.0).alias("audio_seconds"))
    a, b = (sorted(map(tuple, bench.timing_stats(runs, h).collect())) for h in (10, 10**6))
    assert [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1:] for x in a], [x[1:] for x in b])


def test_newest_row_keeps_its_columns(spark):
    d = spark.createDataFrame([("a", "r1", 5, "x"), ("a", "r2", 7, None), ("a", "r3", 7, "y"), ("b", "r1", None, "z")], "case_id string, run_id string, finished_at long, note string")
    got = bench.latest_runs(d)
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == [("a", "r3", 7, "y"), ("b", "r1", None, "z")]


def test_table_function_keeps_partitions_apart(spark):
    class Counted:
        def __init__(self):
            self.n = 0

        def __call__(self, xs):
            self.n += len(xs)
            return [[x, [float(self.n)]] for x in xs]

    d = spark.createDataFrame([(r, i, [float(i)]) for r in (1, 2) for i in range(5)], "rec long, i int, samples array<double>")
    models.register_separator(d, "counted", Counted, 2, 2)
    got = spark.sql("SELECT * FROM counted(TABLE({d}) PARTITION BY rec ORDER BY i)", d=d).collect()
    assert sorted((r["rec"], r["i"], r["samples"][0]) for r in got if r["output_idx"] == 1) == [(r, i, n) for r in (1, 2) for i, n in enumerate([2.0, 2.0, 4.0, 4.0, 5.0])]
    assert sorted((r["rec"], r["i"], r["samples"]) for r in got if r["output_idx"] == 0) == [(r, i, [float(i)]) for r in (1, 2) for i in range(5)]


def test_restoration_by_tags(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(["Елка", "все", "ВСЕ", "Небо", "слезы", "нет"])], "id long, idx int, word string")
    sure = spark.createDataFrame([("елка", "ёлка"), ("слезы", "слёзы"), ("слезы", "слёзыы")], "plain string, restored string")
    doubtful = spark.createDataFrame([("все", "всё"), ("небо", "нёбо")], "plain string, restored string")
    tags = spark.createDataFrame([(1, 2, "YO"), (1, 3, "O"), (1, 4, "YO"), (1, 4, "YO"), (2, 1, "YO")], "id long, idx int, tag string")
    got = [r["word"] for r in text.restore_tagged(words, sure, doubtful, tags).orderBy("idx").collect()]
    assert got == ["Ёлка", "все", "ВСЁ", "Небо", "слезы", "нет"]  # a tagged word that isn't doubtful stays as it was


def test_character_ids(spark):
    d = spark.createDataFrame([(1, "aé\nz"), (2, ""), (3, None)], "id int, t string")
    got = [r[0] for r in d.orderBy("id").select(text.char_ids(F.col("t"), {"a": 7, "é": 8, "[bos]": 5, "\n": 9})).collect()]
    assert got == [[5, 7, 8, 9, 1, 3], [5, 3], [5, 3]] and d.limit(1).select(text.char_ids(F.col("t"), {})).first()[0] == [2, 1, 1, 1, 1, 3]


def test_groups_over_other_words(spark):
    g = spark.createDataFrame([(1, 0, ["a", "a"]), (1, 2, ["b"]), (1, 3, ["c", "c", "c"])], "id int, grp int, words array<string>")
    t = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (1, 2, "r"), (1, 3, "s")], "id int, idx int, word string")
    assert sorted((r["grp"], r["words"]) for r in text.carry_groups(g, t).collect()) == [(0, ["p", "q"]), (2, ["r"]), (3, ["s"])]


def test_prompts_and_pairs(spark):
    assert text.prompt_of("{target} {x}", "en", "fr", "{source_name}>{target_name} {target}: {text}", {"en": "English"}) == "English>fr fr: {target} {x}"
    d = spark.createDataFrame([(1, "a", "en", "fr"), (2, "a", "en", "fr"), (3, "a", "fr", "en"), (4, "b", "en", "xx"), (5, None, "en", "fr"), (6, "c", None, "fr")], "id int, text string, source string, target string")
    seen = spark.sparkContext.accumulator(0)

    def fn(texts, a, b):
        seen.add(len(texts))
        return [f"{a}{b}{t}" for t in texts]

    got = {r["id"]: (r["translated"], r["supported"]) for r in text.translate_batch(d, None, None, fn, {("en", "fr"), ("fr", "en")}).collect()}
    assert got == {1: ("enfra", True), 2: ("enfra", True), 3: ("frena", True), 4: (None, False), 5: (None, True), 6: (None, False)} and seen.value == 2


def test_voice_table_with_its_calibration(spark, tmp_path):
    from murmurlake.sources import reports

    rows = [(f"v{v}", k, k * 40, [float(v)] * 40) for v in (1, 2) for k in range(3)]
    d = spark.createDataFrame(rows, "rec string, block_idx long, start_frame long, samples array<double>")
    table = models.voice_table(d, 24000, lambda xs: [[x.mean(), len(x)] for x in xs])
    assert {r["voice_id"]: [round(v, 6) for v in r["embedding"]] for r in table.collect()} == {"v1": [1, 80], "v2": [2, 80]}
    reports.write_voices(table, str(tmp_path / "t"), calibration="Say this.")
    back = reports.read_voices(spark, str(tmp_path / "t"), True, True).collect()
    assert {(r["voice_id"], r["calibration"], r["error"]) for r in back} == {("v1", "Say this.", None), ("v2", "Say this.", None)}
    with pytest.raises(ValueError, match="calibration"):
        models.voice_table(d, 16000, lambda xs: [[0.0] for _ in xs], most=100)


def test_tables_are_swept_away(spark):
    """What was written to the shared folder goes when asked, and nothing else there."""
    import os

    from murmurlake.functions import lineage

    lineage.sweep(spark)
    folder = lineage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    kept = lineage.settle(spark.range(5))
    assert kept.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert lineage.sweep(spark) == 1 and set(os.listdir(folder)) == before


def test_globs_meet_their_folders(spark):
    variants = spark.createDataFrame([(1, "r", ["w/1/*.bin", "**.json"], 30), (2, "r", ["w/*/x.bin"], 7), (3, "r", ["w/1/a.bin"], 10), (4, "r", ["*"], 1), (5, "q", ["*"], 1), (6, "r", ["w/**"], 17)], "variant_id int, repo string, globs array<string>, size long")
    files = spark.createDataFrame([("r", "w/1/a.bin", 10), ("r", "w/2/x.bin", 7), ("r", "top.json", 15), ("r", "a/b/c.json", 5), ("r", "one", 1)], "repo string, path string, bytes long")
    got = {r["variant_id"]: (r["actual"], r["status"]) for r in bench.check_sizes(variants, files).collect()}
    assert got == {1: (30, "ok"), 2: (7, "ok"), 3: (10, "ok"), 4: (16, "mismatch"), 5: (0, "unreachable"), 6: (17, "ok")}
