"""Streams whose rows come late, twice, out of order or not at all, against the batch operators on what has come."""

import datetime
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmurlake.functions.lineage import shared_folder
from murmurlake.operators import chunks as c
from murmurlake.streaming import live

CONFIG = c.ChunkConfig(1.0, 0.5, "triangular", 8)
#: A row of this recording comes last and much later, so the watermark passes all others.
END = 10_000


def moment(seconds):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)


def signal(spark, recs, n=45):
    rows = [(rec, k, k * 5, [float((rec * 31 + f * 7) % 11) - 5 for f in range(k * 5, min(n, k * 5 + 5))]) for rec in recs for k in range((n + 4) // 5)]
    return spark.createDataFrame(rows, "rec long, block_idx long, start_frame long, samples array<double>")


def staged(spark, batches):
    """A stream that reads one batch a trigger, in this order."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def frames_of(blocks):
    out = {}
    late = {}
    for r in blocks.collect():
        late[r.rec] = late.get(r.rec, 0) + r.late
        for i, x in enumerate(r.samples):
            out.setdefault((r.rec, r.start_frame + i), []).append(round(x, 9))
    return out, late


def cut_up(spark, discard=False):
    """Chunks of recordings 1 to 6 as (rec, chunk_idx) -> row, and their columns."""
    x = c.make_chunks(signal(spark, range(1, 7)), CONFIG, discard).withColumn("chunk_idx", F.col("chunk_idx").cast("long")).select("rec", "chunk_idx", "start_frame", "total", "is_first", "is_last", "samples")
    rows = {(r.rec, r.chunk_idx): r for r in x.collect()}
    return rows, x.schema


def scenario(spark, discard):
    """Batches of chunks with a time, and the chunks that came in time: 1 in order, 2 backwards, 3 replayed after its end, 4 lacks two, 5 stops early, 6 twice what waits."""
    rows, schema = cut_up(spark, discard)
    last = max(k for _, k in rows)
    order = [
        [(1, 0), (2, last), (3, 0), (3, 1), (4, 0), (5, 0), (6, 2), (6, 2)],
        [(1, 1), (2, last - 1), *((3, k) for k in range(2, last + 1)), (4, 1), (5, 1), (6, 2)],
        [*((1, k) for k in range(2, last + 1)), *((2, k) for k in range(last - 1)), (3, 0), (3, last), *((4, k) for k in range(4, last + 1)), (6, 0), (6, 1)],
        [(3, 1), *((6, k) for k in range(3, last + 1))],
    ]
    came = {x for b in order for x in b}
    more = "at timestamp"
    batches = [spark.createDataFrame([(*rows[x], moment(i + 1)) for x in b], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", " + more) for i, b in enumerate(order)]
    batches.append(spark.createDataFrame([(END, 0, 0, 4, True, True, [1.0] * 4, moment(9_000_000))], batches[0].schema))
    return batches, [rows[x] for x in sorted(came)], schema


@pytest.mark.parametrize("kind", ["triangular", "hann", "discard"])
def test_stitch_with_lost_late_and_replayed_chunks(spark, kind):
    """Every frame comes once; it is that of the batch over the chunks that came, or silent; replays are counted."""
    discard = kind == "discard"
    batches, came, schema = scenario(spark, discard)
    stream = staged(spark, batches).withWatermark("at", "0 seconds")
    run = live.stitch_discard_stream(stream, CONFIG, 60_000, "at") if discard else live.stitch_stream(stream, CONFIG, kind, True, 60_000, "at")
    got, late = frames_of(live.drain(run))
    d = spark.createDataFrame(came, schema)
    want, _ = frames_of(c.stitch(d, CONFIG, kind).withColumn("late", F.lit(0)))
    got = {k: v for k, v in got.items() if k[0] != END}
    assert all(len(v) == 1 for v in got.values())
    assert set(got) == {(rec, f) for rec in range(1, 7) for f in range(45)}
    for k, v in got.items():
        assert v[0] == pytest.approx(want[k][-1] if k in want else 0.0, abs=1e-9), k
    assert late == {1: 0, 2: 0, 3: 3, 4: 0, 5: 0, 6: 2, END: 0}


def test_end_without_idle_leaves_a_tombstone(spark):
    batches, _, _ = scenario(spark, False)
    got, late = frames_of(live.drain(live.stitch_stream(staged(spark, batches), CONFIG)))
    assert late[3] == 3 and all(len(v) == 1 for v in got.values())


def test_idle_in_processing_time(spark):
    """A recording that stops is given up by the clock, and its tombstone counts what comes after."""
    batches, came, schema = scenario(spark, False)
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    src = f"{path}-in"
    batches[0].coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(batches[0].schema).parquet(src)
    q = live.stitch_stream(stream, CONFIG, idle=1500).writeStream.option("checkpointLocation", f"{path}-state").format("parquet").option("path", path).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        read = lambda: frames_of(spark.read.schema(f"rec long, {live.BLOCKS}").parquet(path)) if q.lastProgress and q.lastProgress["batchId"] > 0 else ({}, {})
        while time.time() < until and len([k for k in read()[0] if k[0] == 5]) < 45:
            time.sleep(1)
        got, _ = read()
        assert len([k for k in got if k[0] == 5]) == 45
        batches[1].coalesce(1).write.mode("append").parquet(src)
        while time.time() < until and not read()[1].get(5):
            time.sleep(1)
        again, late = read()
        assert late[5] == 1 and {k: v for k, v in again.items() if k[0] == 5} == {k: v for k, v in got.items() if k[0] == 5}
    finally:
        q.stop()


def test_speech_with_lost_and_repeated_frames(spark):
    prob = {1: [0, 1, 1, 0, 1, 0], 2: [1, 1, 0, 0, 1, 1], 3: [0, 1, 0, 1, 0, 1]}
    came = [[(1, 0), (1, 2), (2, 5), (2, 0), (3, 1)], [(1, 1), (1, 3), (1, 2), (2, 1), (2, 2), (3, 2)], [(1, 5), (1, 0), (1, 4), (2, 4), (3, 5)]]
    schema = "rec long, frame long, prob double, at timestamp"
    batches = [spark.createDataFrame([(r, f, float(prob[r][f]), moment(i + 1)) for r, f in b], schema) for i, b in enumerate(came)]
    batches.append(spark.createDataFrame([(END, 0, 0.0, moment(9_000_000))], schema))
    got = live.drain(live.speech_events(staged(spark, batches).withWatermark("at", "0 seconds"), frame_ms=1, idle=1000, event_time="at")).collect()
    want = []
    for rec in prob:
        on = False
        for f in sorted({f for b in came for r, f in b if r == rec}):
            if (prob[rec][f] >= 0.5) != on:
                on = not on
                want.append((rec, f, on))
    assert sorted(map(tuple, got)) == sorted(want)


def swept(rows):
    """The timeline of rows by the batch rules: (seq, speaker, start, end, reset)."""
    session = max((r[0] for r in rows if r[4]), default=-1)
    own = {r[0]: r for r in rows if not r[4] and r[0] > session}.values()
    at = lambda t: len({r[1] for r in own if r[2] <= t < r[3]})
    latest = max((r[2] for r in own), default=-1)
    return (session, sorted((r[2], r[3], r[1]) for r in own), len(own), len({r[1] for r in own}), at(latest), max((at(r[2]) for r in own), default=0))


@pytest.mark.parametrize("closing", [None, 400])
def test_live_turns_equal_the_sweep_at_every_trigger(spark, closing):
    rng = np.random.default_rng(8)
    rows = {rec: [] for rec in (1, 2)}
    for rec in rows:
        start = 0
        for seq in range(60):
            start += int(rng.integers(0, 60))
            rows[rec].append((seq, f"s{rng.integers(0, 4)}", start, start + int(rng.integers(0, 200)), rec == 2 and seq in (17, 40)))
    batches, known = [], []
    for i in range(6):
        part = [(rec, *r) for rec in rows for r in rows[rec][i * 10 : i * 10 + 10]]
        rng.shuffle(part)
        batches.append(spark.createDataFrame([(int(p[0]), int(p[1]), str(p[2]), int(p[3]), int(p[4]), str(p[5]) == "True") for p in part], "rec long, seq long, speaker string, start_ms long, end_ms long, reset boolean"))
    batches.append(batches[-1])  # all of it again is late
    got = live.drain(live.live_turns(staged(spark, batches), closing), "update").collect()
    assert len(got) == 14
    for rec in rows:
        states = sorted((r for r in got if r.rec == rec), key=lambda r: (r.upto, r.late))
        for i, r in enumerate(states):
            session, turns, n, speakers, active, largest = swept(rows[rec][: min(60, i * 10 + 10)])
            assert (r.session, r.n_turns, r.speakers, r.active, r.largest) == (session, n, speakers, active, largest)
            found = [(t.start_ms, t.end_ms, t.speaker) for t in r.turns]
            assert found == (turns if closing is None else [t for t in turns if t[1] >= max(x[0] for x in turns) - closing])
        assert states[-1].late >= 9


def test_timeline_out_of_order_resets(spark):
    """Whatever the order of arrival, the last session is what follows the last reset."""
    rows = [(s, f"s{s % 3}", s * 10, s * 10 + 25, s in (4, 9)) for s in range(14)]
    order = np.random.default_rng(1).permutation(14)
    schema = "rec long, seq long, speaker string, start_ms long, end_ms long, reset boolean"
    batches = [spark.createDataFrame([(7, *rows[i]) for i in order[a : a + 5]], schema) for a in (0, 5, 10)]
    last = max(live.drain(live.live_turns(staged(spark, batches)), "update").collect(), key=lambda r: (r.upto, r.session, r.n_turns))
    session, turns, n, speakers, active, largest = swept(rows)
    assert (last.session, last.n_turns, last.speakers, last.active, last.largest) == (session, n, speakers, active, largest)
    assert [(t.start_ms, t.end_ms, t.speaker) for t in last.turns] == turns
