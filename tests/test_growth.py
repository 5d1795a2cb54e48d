"""What a query costs grows with its input: no call of Python for each short recording or block, no more triggers for more files."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlake.functions.lineage import shared_folder
from murmurlake.jobs import streams
from murmurlake.operators import models, signals, spectral, text
from murmurlake.operators.signals import lengths
from murmurlake.sources import audio
from murmurlake.streaming import live


def plan(df):
    return df._jdf.queryExecution().toString()


def test_staged_files_make_few_triggers(spark):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    x = spark.range(400).select((F.col("id") % 7).alias("rec"), F.col("id").alias("frame"))
    x.repartition(40).write.parquet(path)
    seen = []
    q = streams._read(spark, x.schema, path).writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 400 and len(seen) <= streams.TRIGGERS


class Entries:
    """A map of the state that counts what is written."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):  # noqa: N802
        del self.held[key]


def test_frames_that_wait_share_entries():
    import pandas as pd

    s = live._Speech(0.5, 1, None, None, live.KEEP)
    s.waiting = Entries()
    head, rng = list(s.FRESH), np.random.default_rng(1)
    prob = rng.random(3000)
    order = np.append(rng.permutation(np.arange(1, 3000)), 0)
    out = []
    for part in np.array_split(order, 3):
        out += list(s.take((1,), head, [pd.DataFrame({"frame": part, "prob": prob[part]})]))
    got = pd.concat(out).set_index("at_ms")["is_speech"].to_dict()
    hot = np.append(False, prob >= 0.5)
    assert got == {int(i): bool(hot[i + 1]) for i in np.flatnonzero(hot[1:] != hot[:-1])}
    assert not s.waiting.held and head[:2] == [3000, 0] and s.waiting.writes <= 20


def test_short_files_share_calls(spark):
    rows = [(f"r{i}", c, 16000, k, 3 * k, 3, [float(i + c + 3 * k + j) for j in range(3)], "ok") for i in range(30) for c in range(2) for k in range(2)]
    x = spark.createDataFrame(rows, audio.SIGNALS).repartition(5)
    files = audio.to_wav(x)
    assert "FlatMapGroupsInPandas" not in plan(files)
    by = {r["rec"]: audio.decode_wav(r["content"]) for r in files.collect()}
    assert len(by) == 30 and all(np.allclose(y, np.add.outer(np.arange(6), np.arange(2)) + int(rec[1:])) for rec, (_, y) in by.items())
    back = audio.decode_files(files.select(F.col("rec").alias("path"), "content").union(spark.createDataFrame([("bad", bytearray(b"no"))], "path string, content binary")), 4)
    assert "MapInArrow" in plan(back) and back.where("status = 'ok'").count() == 120 and back.where("rec = 'bad'").first()["status"] == "not a WAV file"


@pytest.mark.parametrize("block", [1, 2, 4])
def test_short_signals_are_inverted_together(spark, block):
    rng = np.random.default_rng(0)
    rows = [(i, 0, 0, rng.random(5 + i % 30).tolist()) for i in range(60)]
    x = spark.createDataFrame(rows, "rec long, block_idx long, start_frame long, samples array<double>")
    y = spectral.istft(spectral.stft(x, 8, 4, size=16), lengths(x), 8, 4, block=block)
    assert "FlatMapGroupsInPandas" not in plan(y)
    got = {}
    for r in y.collect():
        got.setdefault(r.rec, {}).update({r.start_frame + i: v for i, v in enumerate(r.samples)})
    assert all(np.allclose([got[i][k] for k in range(len(s))], s) and len(got[i]) == len(s) for i, _, _, s in rows)


def test_words_stay_where_they_are_for_a_small_dictionary(spark):
    """Joins by a dictionary broadcast it up to a bound; beyond that a shuffle gives the same."""
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(["Abc", "abc", "ABC", "de", "De", "+abc", "x", None])], "id int, idx int, word string").repartition(3)
    sure = spark.createDataFrame([("abc", "a+bc"), ("de", "dee")], "plain string, accented string")
    want = ["A+bc", "a+bc", "A+BC", "dee", "dee", "+abc", "x", None]

    def run():
        x = text.restore_accents(words, sure)
        return x, [r["word"] for r in x.orderBy("idx").collect()]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    most = text.MOST_ENTRIES
    try:
        x, got = run()
        assert "BroadcastHashJoin" in plan(x) and got == want
        text.MOST_ENTRIES = 1
        x, got = run()
        assert "BroadcastHashJoin" not in plan(x) and got == want
    finally:
        text.MOST_ENTRIES = most
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_cut_where_they_are(spark):
    """No shuffle, sort or gathering of words, few texts in a worker at a time; rows that share an id, or have none, are texts of their own."""
    texts = [(1, "the  çà the", "the x"), (1, "x", None), (None, "thé the", ""), (2, None, "x"), (3, "", None), (4, "a" * 50 + " the", "q")]
    d = spark.createDataFrame(texts, "id long, text string, pair string").coalesce(1)
    pieces = ["[UNK]", "[SPACE]", "[CLS]", "[SEP]", "the", "x", "a", "##a", "ç", "##à"]
    vocab, ranks = {p: i for i, p in enumerate(pieces)}, {("t", "h"): 0, ("th", "e"): 1}
    whole = lambda t: [v for i, w in enumerate((t or "").split(" ")) for v in [1] * (i > 0) + [pieces.index(p) if p in pieces else 0 for p in text.bpe(w, ranks)]]
    first = lambda t: [p for w in (t or "").split(" ") for p in text.WordPieces(pieces)(w)]
    held = text.CUT_BYTES
    try:
        for text.CUT_BYTES in (1, 40, held):
            b, w = text.tokenize_bpe(d, vocab, ranks, ["[SPACE]"], nfkd=False), text.tokenize_wordpiece(d, vocab, 300)
            assert not any(k in plan(y) for y in (b, w) for k in ("Exchange", "Sort", "Aggregate", "Generate", "Join"))
            assert [(r["id"], r["ids"], r["n"]) for r in b.collect()] == [(i, whole(t), len(whole(t))) for i, t, _ in texts]
            for r, (i, t, pair) in zip(w.collect(), texts, strict=True):
                ids = [pieces.index(p) for p in ["[CLS]", *first(t), "[SEP]", *([*first(pair), "[SEP]"] if pair is not None else [])]]
                assert r["id"] == i and r["ids"] == ids + [0] * (300 - len(ids)) and len(r["offsets"]) == len(first(t))
            assert [tuple(o) for o in w.first()["offsets"]] == [(0, 3, False), (5, 7, False), (5, 7, True), (8, 11, False)]
    finally:
        text.CUT_BYTES = held


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_channels_are_converted_in_one_pass(spark):
    """A signal is read once and joined once, whatever it has and wants, and rates come along: each join or union more is a sort that the same task holds."""
    have = {1: 1, 2: 2, 3: 3, 4: 2, 5: 1, 6: 3}
    rows = [(r, c, k, 3 * k, [float(r * 100 + c * 10 + 3 * k + i) for i in range(3)]) for r, n in have.items() for c in range(n) for k in range(2)]
    x = spark.createDataFrame(rows, "rec long, channel short, block_idx long, start_frame long, samples array<float>")
    want = {1: 2, 2: 2, 3: 1, 4: 0, 5: None}
    needs = spark.createDataFrame([*want.items()], "rec long, channels int")
    y = signals.convert_channels(x, needs)
    assert "Union" not in logical(y) and logical(y).count("Join ") == 2 and logical(signals.convert_channels(x, 2)).count("Join ") == 1
    assert y.schema["channel"].dataType == x.schema["channel"].dataType and y.columns == x.columns
    got = {(r.rec, r.channel, r.start_frame): r.samples for r in y.collect()}
    mean = {(r, k): np.mean([s for i, _, _, at, s in rows if (i, at) == (r, k)], axis=0).tolist() for r in have for k in (0, 3)}
    same = {(r, c, at): s for r, c, _, at, s in rows if r == 2}
    assert got == same | {(1, c, k): mean[1, k] for c in (0, 1) for k in (0, 3)} | {(3, 0, k): mean[3, k] for k in (0, 3)}
    z = models.adapt(x.withColumn("sample_rate", F.lit(8)), needs.where("rec <= 3").withColumn("rate", F.when(F.col("rec") == 1, 16).otherwise(8)), "fast")
    assert logical(z).count("Join ") <= 4
    assert {(r.rec, r.channel): (r.sample_rate, len(r.samples)) for r in z.collect()} == {(1, 0): (16, 12), (1, 1): (16, 12), (2, 0): (8, 6), (2, 1): (8, 6), (3, 0): (8, 6)}


def shuffled(df):
    """Rows that each shuffle of the plan, run, has written."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        todo += [p.children().apply(i) for i in range(p.children().size())]
        m = p.metrics().get("shuffleRecordsWritten")
        out += [m.get().value()] if m.isDefined() else []
    return out


def test_only_rare_words_are_shuffled_for_a_large_dictionary(spark):
    """Frequent words stay where they are, whether the dictionary has them or not, and tags that come with words need no join by place."""
    rare = [f"w{chr(97 + i)}x" for i in range(20)]
    line = ["Abc", "abc", "ABC", "de", "of", "Of"] * 200 + rare + [w.upper() for w in rare[:5]] + [None] * 50
    words = spark.createDataFrame([(1, i, w, "YO" if i % 4 == 0 else "O" if i % 4 < 3 else None) for i, w in enumerate(line)], "id int, idx int, word string, tag string")
    sure = spark.createDataFrame([("abc", "xbc"), ("abc", "ybc"), *((w, "y" + w[1:]) for w in rare[:15])], "plain string, restored string")
    doubtful = spark.createDataFrame([("de", "ed"), *((w, w[::-1]) for w in rare[5:])], "plain string, restored string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = words.select("id", "idx", "word")
        for accents in (False, True):
            got = []
            for text.MOST_ENTRIES in (500_000, 8, 1):
                run = lambda: text.restore_accents(plain, sure.where("restored <> 'ybc'").withColumnRenamed("restored", "accented")) if accents else text.restore_tagged(words, sure, doubtful)
                x = run()
                got.append([r["word"] for r in sorted(x.collect(), key=lambda r: r["idx"])])
                if text.MOST_ENTRIES == 8:
                    assert max(shuffled(x)) <= 40 and "BroadcastHashJoin" in plan(x)
            assert got[0] == got[1] == got[2] and len(got[0]) == len(line)
        tags = words.select("id", "idx", "tag")
        assert [r["word"] for r in sorted(text.restore_tagged(plain, sure, doubtful, tags).collect(), key=lambda r: r["idx"])] == [r["word"] for r in sorted(text.restore_tagged(words, sure, doubtful).collect(), key=lambda r: r["idx"])]
    finally:
        text.MOST_ENTRIES = 500_000
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
