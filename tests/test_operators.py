"""Literal cases of operators, and parities: any block size, any chunk plan. Streams have tests of their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlake.functions.intervals import intersection, overlaps
from murmurlake.jobs.pipeline import ConfigurationError, Pipeline, stage_metrics
from murmurlake.operators import bench, chunks, embeddings, models, signals, spectral, text, timeline, vad, words
from murmurlake.sources import audio, reports


def turns(spark, rows):
    return spark.createDataFrame([(i, 1, f"speaker_{s}", a * 1000, b * 1000, 1.0) for i, (s, a, b) in enumerate(rows)], "turn_id long, rec long, speaker string, start_ms long, end_ms long, conf double")


@pytest.mark.parametrize(
    ("given", "most", "ranges"),
    [
        ([(0, 0, 3), (1, 2, 5), (0, 6, 8)], 2, [(2, 3)]),
        ([(0, 0, 10), (0, 1, 9), (1, 4, 5)], 2, [(4, 5)]),
        ([(0, 0, 10), (1, 0, 4), (2, 6, 10)], 2, [(0, 4), (6, 10)]),
        ([(0, 0, 2), (1, 1, 1)], 1, []),
        ([(0, 0, 2), (1, 2, 4), (0, 4, 6)], 1, []),
    ],
)
@pytest.mark.parametrize("shard", [1500, 3_600_000])
def test_overlaps(spark, given, most, ranges, shard):
    t = turns(spark, given)
    assert timeline.max_overlapping_speakers(t).first()["n"] == most
    assert sorted((r["start_ms"] // 1000, r["end_ms"] // 1000) for r in timeline.overlapping_ranges(t, shard).collect()) == ranges


def test_interval_predicates(spark):
    x = spark.sql("SELECT * FROM VALUES (0, 2, 2, 4), (0, 3, 2, 4), (0, 4, 1, 1) AS t(a, b, c, d)").select(overlaps(*map(F.col, "abcd")).alias("o"), intersection(*map(F.col, "abcd")).alias("x")).collect()
    assert [r["o"] for r in x] == [False, True, True]
    assert [r["x"] and tuple(r["x"]) for r in x] == [None, (2, 3), None]


def test_attribution_adds_turns_of_one_speaker(spark):
    w = spark.createDataFrame([(1, 1, "a", 0, 10_000), (1, 2, "b", 50_000, 60_000)], "rec long, word_id long, text string, start_ms long, end_ms long")
    t = turns(spark, [(0, 0, 4), (0, 4, 8), (1, 0, 5)])
    got = {r["word_id"]: r for r in timeline.attribute_words(w, t, 3000).collect()}
    assert got[1]["speaker"] == "speaker_0" and got[1]["active"] == ["speaker_0", "speaker_1"] and math.isclose(got[1]["confidence"], 8 / 13)
    assert got[2]["speaker"] is None and got[2]["active"] == [] and got[2]["confidence"] == 0


def test_gaps_and_share(spark):
    t = turns(spark, [(0, 1, 3), (0, 2, 2), (1, 5, 6)])
    recs = spark.createDataFrame([(1, 8000), (2, 3000)], "rec long, total_ms long")
    assert sorted(tuple(r) for r in timeline.gaps(t, recs).collect()) == [(1, 0, 1000), (1, 3000, 5000), (1, 6000, 8000), (2, 0, 3000)]
    assert {r["rec"]: r["pct"] for r in timeline.speech_share(t, recs).collect()} == {1: 37.5, 2: 0.0}


def test_vad_joins_and_drops(spark):
    hot = {0, 1, 3, 10}
    f = spark.createDataFrame([(1, i, 0.9 if i in hot else 0.1) for i in range(12)], "rec long, frame long, prob double")
    assert sorted((r["start_ms"], r["end_ms"]) for r in vad.segments_from_probs(f).collect()) == [(0, 1024), (2560, 2816)]
    assert vad.segments_from_probs(f, min_speech=300).count() == 1


@pytest.mark.parametrize("shard", [1, 10_000])
@pytest.mark.parametrize(
    ("pieces", "want"),
    [([" Hel", "lo", " wor", "ld"], ["Hello", "world"]), (["a", "b", "\nc"], ["ab", "c"]), ([" ", "x", " y"], ["x", "y"]), ([" "], []), ([" a ", "b"], ["ab"])],
)
def test_words(spark, pieces, want, shard):
    t = spark.createDataFrame([(1, i, p, i * 10, i * 10 + 10, 0.5) for i, p in enumerate(pieces)], "rec long, idx int, token string, start_ms long, end_ms long, confidence double")
    assert [r["word"] for r in words.merge_tokens_into_words(t, shard).orderBy("start_ms").collect()] == want


def test_word_times(spark):
    d = spark.createDataFrame([(1, [5, 2, 3, 4, 2, 2, 9]), (2, [1, 1])], "utt long, durations array<int>")
    p = spark.createDataFrame([(1, 0, "ab", True), (1, 1, "c", False), (1, 2, None, False), (1, 3, "defgh", False), (2, 0, "a", False)], "utt long, idx int, phones string, is_space boolean")
    got = [(r["idx"], r["start"] * 80, r["end"] * 80) for r in words.word_times(p, d).orderBy("idx").collect()]
    # The clock: 2 * (5 - 3) = 4; the first word 2 * (2 + 3) and its space 4, so it ends at 18 and the clock stands at 22.
    assert got == [(0, 4.0, 18.0), (1, 18.0, 26.0)]
    p = spark.createDataFrame([(1, 0, None, True), (1, 1, "c", False)], "utt long, idx int, phones string, is_space boolean")
    assert [(r["start"] * 80, r["end"] * 80) for r in words.word_times(p, d).collect()] == [(7.0, 18.0)]


def blocks(spark, data, size, rec=1):
    return spark.createDataFrame([(rec, k // size, k, [float(v) for v in data[k : k + size]]) for k in range(0, len(data), size)], "rec long, block_idx long, start_frame long, samples array<double>")


def flat(df):
    out = {}
    for r in df.collect():
        for i, v in enumerate(r["samples"]):
            assert r["start_frame"] + i not in out
            out[r["start_frame"] + i] = v
    assert sorted(out) == list(range(len(out)))
    return np.array([out[k] for k in sorted(out)])


@pytest.mark.parametrize("size", [7, 100])
def test_mix_and_replace(spark, size):
    a, b = blocks(spark, [1, 1, 1], size), blocks(spark, [0.5, 0.5], size)
    assert flat(signals.mix(a, b, 1, size)).tolist() == [1, 1.5, 1.5]
    assert flat(signals.mix(blocks(spark, [1, 1, 1], size), blocks(spark, [2, 2], size), -1, size)).tolist() == [2, 3, 1, 1]
    r = spark.createDataFrame([(1, 1, 2)], "rec long, lo long, hi long")
    assert flat(signals.replace_range(blocks(spark, [1, 2, 3], size), r, blocks(spark, [9, 9, 9], size))).tolist() == [1, 9, 9, 9, 3]
    assert flat(signals.subtract(signals.reblock(blocks(spark, [1, 2, 3], size), 4), signals.reblock(blocks(spark, [0.5, 0.5], size), 4))).tolist() == [0.5, 1.5]


@pytest.mark.parametrize(("n", "seconds", "rate", "overlap"), [(5000, 1.024, 1000, 0.5), (3333, 0.8, 1000, 0.25), (300, 1.024, 1000, 0.5), (2350, 1.0, 1000, 0.25), (2048, 0.511, 1000, 0.5)])
def test_stitch_returns_what_was_cut(spark, n, seconds, rate, overlap):
    x = np.random.default_rng(n).uniform(-1, 1, n)
    config = chunks.ChunkConfig(seconds, overlap, "triangular", rate)
    cut = chunks.make_chunks(blocks(spark, x, 700), config)
    for blend in ("none", "discard", "triangular", "hann"):
        assert np.allclose(flat(chunks.stitch(cut, config, blend)), x, atol=1e-6), blend
    edges = flat(chunks.stitch(cut, config, "hann", flat=False))
    assert np.allclose(edges[1:-1], x[1:-1], atol=1e-6) and edges[0] == 0


def test_two_outputs_in_one_pass(spark):
    x = np.arange(500.0)
    config = chunks.ChunkConfig(0.1, 0.25, "triangular", 1000)
    two = models.separate(chunks.make_chunks(blocks(spark, x, 64), config), lambda xs: [(v, -v) for v in xs], 2)
    got = chunks.stitch_multi(two, config)
    assert np.allclose(flat(got.where("output_idx = 0").drop("output_idx")), x) and np.allclose(flat(got.where("output_idx = 1").drop("output_idx")), -x)


@pytest.mark.parametrize("size", [333, 5000])
def test_resample_by_block_is_resample_of_all(spark, size):
    t = np.arange(4000) / 48000
    x = np.sin(2 * np.pi * 15000 * t)
    cubic, sinc = (flat(signals.resample(blocks(spark, x, 512), 48000, 16000, m, size)) for m in ("balanced", "high"))
    tone = lambda y, hz: abs(np.exp(-2j * np.pi * hz * np.arange(len(y)) / 16000) @ y) * 2 / len(y)
    assert tone(cubic, 1000) > 0.05 and tone(sinc, 1000) < tone(cubic, 1000) / 10
    low = np.sin(2 * np.pi * 500 * t)
    y = flat(signals.resample(blocks(spark, low, 512), 48000, 16000, "auto", size))
    assert np.abs(y[60:-60] - low[::3][60 : len(y) - 60]).max() < 0.01
    lag = signals.best_lag(blocks(spark, y, 512), blocks(spark, low[::3], 512)).first()["lag"]
    assert lag == 0


def test_normalize_and_levels(spark):
    s = blocks(spark, [0.1, -0.2, 0.05], 2)
    assert math.isclose(signals.levels(signals.normalize(s, "peak", 0.0)).first()["peak"], 1.0)
    assert signals.levels(signals.normalize(s, "rms", 20.0)).first()["peak"] <= 0.99 + 1e-9
    assert math.isclose(signals.levels(signals.normalize(s, "floor", 0.5)).first()["rms"], 0.5)


def test_stft_round_trip_and_block_independence(spark):
    x = np.random.default_rng(1).uniform(-1, 1, 3000)
    total = spark.createDataFrame([(1, 3000)], "rec long, n long")
    a, b = (spectral.stft(blocks(spark, x, 512), 256, 64, size=k) for k in (640, 100_000))
    bins = [np.array([r["bins"] for r in d.orderBy("frame").collect()]) for d in (a, b)]
    assert bins[0].shape == bins[1].shape and np.allclose(*bins)
    assert np.allclose(flat(spectral.istft(a, total, 256, 64, block=8)), x, atol=1e-8)


def test_features(spark):
    x = blocks(spark, np.random.default_rng(2).uniform(-1, 1, 8000), 1000)
    m = spectral.log_mel(x, 16000, 20).collect()
    top = max(max(r["bins"]) for r in m)
    assert all(min(r["bins"]) >= top - 2 - 1e-9 for r in m)
    f = spectral.kaldi_fbank(x, 16000, 10)
    assert f.count() == (8000 - 400) // 160 + 1
    d = spectral.with_deltas(f).orderBy("frame").collect()
    v = np.array([r["bins"] for r in d])
    assert v.shape[1] == 30 and np.allclose(v[5, 10:20], sum(k * (v[5 + k, :10] - v[5 - k, :10]) for k in (1, 2)) / 10)


def test_blend_and_top_k(spark):
    eye = np.eye(4)
    v = spark.createDataFrame([(i, eye[i].tolist()) for i in range(4)], "voice_id long, embedding array<double>")
    r = spark.createDataFrame([(9, [0.6, 0.4, 0.0, 0.0])], "ref_id long, embedding array<double>")
    b = embeddings.blend_voices(r, v, 3).first()
    assert b["voice_ids"][:2] == [0, 1] and abs(b["weights"][0] - 0.6) < 0.1 and abs(sum(b["weights"]) - 1) < 1e-9
    assert [x["voice_id"] for x in embeddings.top_k_voices(r, v, 2).orderBy("rank").collect()] == [0, 1]
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 2.0], [-3.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, d array<double>, z array<double>")
    assert list(c.select(*(embeddings.cosine(F.col("a"), F.col(k)) for k in "bcdz")).first()) == [1.0, 0.0, -1.0, 0.0]


def test_utterance_windows(spark):
    got = spark.createDataFrame([(n,) for n in (10, 160, 240, 300)], "n int").select(embeddings.utterance_windows(F.col("n")).alias("w")).collect()
    assert [r["w"] for r in got] == [[0], [0], [0, 80], [0, 80, 160]]
    u = spark.createDataFrame([(1, [[1.0, 0.0]] * 200)], "utt long, mels array<array<double>>")
    e = embeddings.utterance_embeddings(u, lambda ws: [w.mean(axis=0) for w in ws]).first()["embedding"]
    assert np.allclose(e, [1, 0])


def test_text(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(text.punc_norm, "") == text.EMPTY
    assert one(text.punc_norm, "hi  there") == "Hi there." and one(text.punc_norm, "what?") == "What?"
    assert one(text.stress_marks, "з+амок+") == "за́мок"
    assert text.WordPieces(["view", "##er"])("viewer") == ["view", "##er"] and text.WordPieces([])("x" * 101) == ["[UNK]"]
    assert text.bpe("abab", {("a", "b"): 0, ("ab", "ab"): 1}) == ["abab"]
    s = spark.createDataFrame([(1, "Да. Нет?  Да!")], "id long, text string")
    assert [(r["sentence"], r["sep"]) for r in text.split_sentences(s).orderBy("idx").collect()] == [("Да.", " "), ("Нет?", "  "), ("Да!", "")]
    w = text.split_words(s.withColumnRenamed("text", "sentence")).orderBy("idx").collect()
    assert "".join(r["before"] + r["word"] for r in w) == "Да. Нет?  Да!"
    t = spark.createDataFrame([(1, "Да нет.  ", "x"), (2, "", None)], "id long, text string, pair string")
    assert [(r["sentence"], r["sep"]) for r in text.split_sentences(t).collect()] == [("Да нет.", "  ")]
    got = {r["id"]: r for r in text.tokenize_wordpiece(t, {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "да": 4, "н": 5, "##ет": 6}, 9).collect()}
    assert got[1]["ids"] == [2, 4, 5, 6, 1, 3, 1, 3, 0] and got[1]["type_ids"] == [0] * 6 + [1, 1, 0] and got[1]["mask"] == [1] * 8 + [0]
    assert [tuple(o) for o in got[1]["offsets"]] == [(0, 2, False), (3, 7, False), (3, 7, True), (3, 7, True)] and got[2]["ids"] == [2, 3] + [0] * 7
    short = text.tokenize_wordpiece(t, {"[UNK]": 1, "[CLS]": 2, "[SEP]": 3}, 4).where("id = 1").first()
    assert len(short["ids"]) == 4 and short["ids"][-1] == 3
    assert text.WordPieces(["click"])("click?") == ["click", "[UNK]"]
    b = text.tokenize_bpe(spark.createDataFrame([(1, "Ab ﬁ")], "id long, text string"), {"[UNK]": 0, "[fr]": 1, "[SPACE]": 2, "ab": 3, "fi": 4}, {("a", "b"): 0, ("f", "i"): 1}, ["[fr]", "[SPACE]"], lang="FR").first()
    assert b["ids"] == [1, 3, 2, 4] and b["n"] == 4
    assert one(text.close_up, "a ~ b - c ( d , e") == "a - b-c( d, e" and one(text.clean_text, "Да☃ , нет~") == "Да, нет"
    five = spark.createDataFrame([(1, i, "so") for i in range(5)] + [(1, i, "So") for i in range(5, 9)] + [(2, i, "+да") for i in range(7)], "id long, idx int, word string")
    got = text.group_words(five, spark.createDataFrame([("да",)], "base string")).orderBy("id", "grp").collect()
    assert [len(r["words"]) for r in got] == [5, 2, 2, 3, 3, 1]


def test_bench(spark):
    runs = spark.createDataFrame([("a", 2.0, 30.0), ("a", 4.0, 30.0), ("b", 0.0, 30.0)], "case_id string, seconds double, audio_seconds double")
    got = {r["case_id"]: r for r in bench.timing_stats(runs).collect()}
    assert got["a"]["median_s"] == 3 and got["a"]["rtf"] == 10 and got["b"]["sd_s"] == 0 and math.isnan(got["b"]["rtf"])
    g = spark.createDataFrame([("w/*.bin",), ("w/**.bin",)], "g string").select(bench.glob_regex(F.col("g")).alias("r")).collect()
    assert [r["r"] for r in g] == [r"^w/[^/]*\.bin$", r"^w/.*\.bin$"]
    v = spark.createDataFrame([("a", "r", ["w/?.bin"], 100), ("b", "r", ["w/*"], 95), ("c", "r", ["w/*"], None), ("d", "q", ["*"], 1)], "variant_id string, repo string, globs array<string>, size long")
    f = spark.createDataFrame([("r", "w/x.bin", 60), ("r", "w/y.bin", 40)], "repo string, path string, bytes long")
    assert {r["variant_id"]: r["status"] for r in bench.check_sizes(v, f, 0.05).collect()} == {"a": "matches nothing", "b": "within tolerance", "c": "not in catalog", "d": "unreachable"}
    assert {r["variant_id"]: r["status"] for r in bench.check_sizes(v, f).collect()}["b"] == "mismatch"


def test_wav_round_trip(spark, tmp_path):
    x = np.random.default_rng(3).uniform(-1, 1, (1000, 2)).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(x, 16000))
    (tmp_path / "b.wav").write_bytes(b"RIFF....nope")
    got = audio.read_wav(spark, str(tmp_path), 300)
    ok, bad = audio.split_ingest(got)
    assert bad.count() == 1 and ok.count() == 8
    rate, y = audio.decode_wav(audio.to_wav(ok).first()["content"])
    assert rate == 16000 and np.array_equal(x, y)
    with pytest.raises(ValueError):
        audio.encode_wav(np.zeros((0, 1)), 16000)


def test_two_channels_through_the_library(spark, tmp_path):
    """WAV, resampling, chunks, a model, stitching, WAV: each channel as if it were alone."""
    x = np.random.default_rng(4).uniform(-1, 1, (3000, 2)).astype(np.float32)
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(x, 8000))
    s = signals.blocks_of(audio.read_wav(spark, str(tmp_path), 700))
    assert {(r["channel"], round(r["rms"], 6)) for r in signals.levels(s).collect()} == {(c, round(float(np.sqrt((x[:, c].astype(float) ** 2).mean())), 6)) for c in (0, 1)}
    config = chunks.ChunkConfig(0.05, 0.25, "triangular", 16000)
    up = signals.resample(s, 8000, 16000, "fast", 500)
    done = chunks.stitch(models.apply_model(chunks.make_chunks(up, config), lambda xs: [v * 2 for v in xs]), config)
    files = audio.to_wav(done.select("rec", "channel", F.lit(16000).alias("sample_rate"), "start_frame", F.size("samples").alias("n_frames"), F.col("samples").cast("array<float>").alias("samples"), F.lit("ok").alias("status")))
    rate, y = audio.decode_wav(files.first()["content"])
    want = np.stack([2 * np.interp(np.arange(6000) / 2, np.arange(3000), x[:, c]) for c in (0, 1)], axis=1)
    assert rate == 16000 and np.allclose(y, want, atol=1e-5)


def test_synthetic_signals(spark):
    spec = spark.createDataFrame([(1, "sine", 10.0, 1.0, 100, 0), (2, "noise", 0.0, float("nan"), 100, 0), (3, "harmonic", 0.0, 0.5, 100, 1)], "rec long, kind string, hz double, seconds double, rate int, seed int")
    s = audio.synth_signals(spark, spec, 30)
    assert np.allclose(flat(s.where("rec = 1")), 0.5 * np.sin(2 * np.pi * 10 * np.arange(100) / 100)) and s.where("rec = 2").count() == 0


def test_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"runID": "r", "configuration": {"buildConfiguration": "debug"}, "results": [{"id": "c", "inputSampleRate": 100, "inputFrames": 250, "timing": {"iterationSeconds": [1.5, "nan"], "stdDevSeconds": "inf"}, "memory": {"weightsMaterializedAtLoad": false}}]}')
    r = reports.read_bench_reports(spark, str(tmp_path / "r.json")).first()
    assert r["case_id"] == "c" and r["seconds"][0] == 1.5 and math.isnan(r["seconds"][1]) and r["audio_seconds"] == 2.5 and r["sd_s"] == float("inf") and r["build"] == "debug" and not r["materialized"]
    (tmp_path / "v.json").write_text('{"voiceIds": ["a", "b"], "embeddings": [[1, 2], [3]]}')
    assert reports.read_voices(spark, str(tmp_path / "v.json")).first()["error"] == "dimensions differ"
    w = spark.createDataFrame([(1, 1, 61_500, 62_000, None, "hi"), (1, 2, 0, 10, "speaker_1", "yo")], "rec long, word_id long, start_ms long, end_ms long, speaker string, text string")
    assert reports.render_transcript(w).first()["text"] == "[00:00.00] Speaker speaker_1: yo\n[01:01.50] Speaker Unknown: hi"
    reports.write_words_csv(w, str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).count() == 2
    seg = spark.createDataFrame([(1, 0, 500, "a.wav", "speech")], "rec long, start_ms long, end_ms long, file string, type string")
    assert '"totalDuration":2.0' in reports.segment_manifest(seg, spark.createDataFrame([(1, 2000)], "rec long, total_ms long")).first()["json"]


def test_pipeline(spark):
    p = Pipeline().transcribe(lambda s: s).merge()
    with pytest.raises(ConfigurationError):
        p.check(("signals",))
    p.check(("signals", "turns"))
    x = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, None, None)], "rec long, n int, m int")
    routed = Pipeline().conditionally("signals", F.col("n") == 2, lambda d: d.withColumn("m", F.lit(20)), lambda d: d.withColumn("m", F.lit(0))).run(signals=x)["signals"]
    assert {r["rec"]: r["m"] for r in routed.collect()} == {1: 20, 2: 0, 3: 0}
    par = Pipeline().parallel("signals", [lambda d: d.where("rec = 1").select("rec", F.lit(7).alias("m")), lambda d: d.where("rec < 3").select("rec", F.lit(8).alias("m"))]).run(signals=x)["signals"]
    assert {r["rec"]: r["m"] for r in par.collect()} == {1: 8, 2: 8, 3: None}
    e = spark.createDataFrame([("r", None, "a", 0.0), ("r", None, "a", 2.0), ("r", 1, "a", 1.0), ("r", 1, "a", 5.0)], "run string, branch int, stage string, at double")
    assert {r["stage"]: r["duration"] for r in stage_metrics(e).collect()} == {"a": 2.0, "parallel[1].a": 4.0, "total": 5.0}


def test_model_surface(spark):
    s = blocks(spark, [1.0, 2.0, 3.0], 3)
    assert models.apply_model(s, lambda xs: [x * 2 for x in xs]).first()["samples"] == [2.0, 4.0, 6.0]
    two = lambda k: (lambda: lambda xs: [x * k for x in xs])
    assert [models.apply_model(s, make=two(k)).first()["samples"][0] for k in (2, 3)] == [2.0, 3.0]
    assert models.analyze(s, lambda xs: [[{"n": len(x)}] for x in xs], "n int").first()["n"] == 3
    t = spark.createDataFrame([("a", [2.0]), ("b", [3.0])], "target string, weights array<double>")
    assert {r["target"]: r["samples"][0] for r in models.fan_out(s, t, lambda x, w: x * w[0]).collect()} == {"a": 2.0, "b": 3.0}
    assert models.embed(s, lambda xs: [[x.sum()] for x in xs]).first()["embedding"] == [6.0]
    assert models.map_text(spark.createDataFrame([("x",)], "text string"), lambda ts: [t * 2 for t in ts]).first()["text"] == "xx"


def test_barrier_takes_chunks_of_any_number_of_partitions(spark):
    """More partitions than slots, and fewer by coalesce: a barrier's stage allows neither."""
    from murmurlake.operators import models as m

    x = spark.range(40).selectExpr("id AS rec", "array(CAST(id AS DOUBLE)) AS samples")
    for chunks in (x.repartition(23), x.repartition(23).coalesce(2)):
        got = m.apply_model(chunks, lambda xs: [v * 2 for v in xs], barrier=True)
        assert sorted(r.samples[0] for r in got.collect()) == [2.0 * i for i in range(40)]


def test_variants_of_the_same_globs_are_matched_once(spark):
    """2,000 variants of two sets of globs over 400 files: pairs of sets and files, not of variants and files."""
    from murmurlake.operators import bench as b

    variants = spark.range(2000).selectExpr("id AS variant_id", "concat('r', id % 2) AS repo", "IF(id % 3 = 0, array('a/*.x', 'a/**'), array('a/**', 'a/*.x')) AS globs", "CAST(200 AS BIGINT) AS size")
    files = spark.range(400).selectExpr("concat('r', id % 2) AS repo", "concat('a/', id, '.x') AS path", "CAST(1 AS BIGINT) AS bytes")
    got = b.check_sizes(variants, files)
    assert {(r.actual, r.status) for r in got.collect()} == {(200, "ok")} and got.count() == 2000
    joined = [n for n in _rows_out(got) if n >= 2000 * 200]
    assert not joined


def _rows_out(df):
    """Rows that each node of the plan, run, has put out."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        todo += [p.children().apply(i) for i in range(p.children().size())]
        m = p.metrics().get("numOutputRows")
        out += [m.get().value()] if m.isDefined() else []
    return out


def test_slots_tie_after_rounding(spark):
    """Means that are equal to the digits asked for go to the first slot."""
    x = spark.createDataFrame([(1, [0.2, 0.20000001]), (2, [0.1, 0.3])], "track int, probs array<double>")
    got = {r.track: (r.slot, r.conf) for r in timeline.identify_slot(x, 6).collect()}
    assert got == {1: (0, 0.2), 2: (1, 0.3)}


def test_windows_that_keep_no_tokens_are_null(spark, tmp_path):
    """As in the SQL: no text, and not an empty one."""
    from murmurlake.jobs import registry

    e = spark.range(9).selectExpr("IF(id < 2, id * 500, id) AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "IF(id < 2, 1L, 2L) AS user_id", "'view' AS event_type", "1D AS value")
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.rec: (r.n, r.ids) for r in registry.QUERIES["merge_token_windows"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, None), 2: (7, "2,3,4,5,6,7,8")}


def test_deltas_of_many_short_recordings_cross_python_together(spark):
    """2,000 recordings of three frames, of two widths: each row as of its recording alone, in a frame for many recordings."""
    x = spark.range(6000).selectExpr("id DIV 3 AS rec", "id % 3 AS frame", "IF(id DIV 3 % 2 = 0, array(CAST(id % 3 AS DOUBLE)), array(CAST(id % 3 AS DOUBLE), 1D)) AS bins")
    got = spectral.with_deltas(x, 2, 2)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    rows = {(r.rec % 2, r.frame, tuple(round(v, 6) for v in r.bins)) for r in got.collect()}
    assert got.count() == 6000 and len(rows) == 6
    assert (0, 1, (1.0, 0.6, 0.0)) in rows
