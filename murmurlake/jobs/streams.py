"""Queries that run the streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import scratch
from ..operators import chunks as c
from ..sources import views as v
from ..streaming import live
from .signals import CONFIG, DISCARD, DISCARD_TAIL, flat


#: Triggers that staged files make at most, however many they are: each of them visits every partition of the state.
TRIGGERS = 3


def _read(s: SparkSession, schema: StructType, path: str, least: int = 4) -> DataFrame:
    """Staged files as a stream, `least` of them a trigger or as many as TRIGGERS need."""
    files = len(s.read.schema(schema).parquet(path).inputFiles())
    return s.readStream.schema(schema).option("maxFilesPerTrigger", max(least, -(-files // TRIGGERS))).parquet(path)


def _staged(s: SparkSession, df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read as a stream."""
    path = scratch(s)
    df.write.parquet(path)
    return _read(s, df.schema, path)


def _whole(df: DataFrame) -> DataFrame:
    """Dealt so that a recording's rows, in any order, are in one file: a visit to a recording costs the same for a row as for a hundred."""
    return df.repartition("rec")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    return _staged(s, v.table(s, d, "events").repartition(4))


def _turns(s, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _stream(s, d).select(F.date_format("ts", "yyyyMMdd").cast("long").alias("rec"), F.concat(F.lit("speaker_"), (F.col("user_id") % 4).cast("string")).alias("speaker"), (F.floor(us % 86400000000 / 1000) + F.round(F.col("value") * 10000)).cast("long").alias("end_ms"))


def _chunks(s, d, discard=False):
    return c.make_chunks(v.blocks(s, d), CONFIG, discard).withColumn("at", F.timestamp_seconds(F.col("chunk_idx") + 10**8))


def _replayed(s, d):
    """All chunks, then the first and the last of each recording once more."""
    path = scratch(s)
    x = _chunks(s, d)
    _whole(x).write.parquet(path)
    s.read.schema(x.schema).parquet(path).where("is_first OR is_last").write.mode("append").parquet(path)
    found = live.drain(live.stitch_stream(_read(s, x.schema, path, 8), CONFIG))
    total = F.sum(F.aggregate("samples", F.lit(0.0), lambda a, y: a + y))
    return found.groupBy("rec").agg(F.sum(F.size("samples")).alias("n"), F.round(total, 5).alias("total"), F.sum("late").alias("late"))


def _cut_short(s, d):
    """Every third chunk is lost, the last ones of some recordings with it; the watermark ends them, by a row that comes last and much later."""
    lost = _chunks(s, d).where("chunk_idx % 3 <> 2")
    path = scratch(s)
    _whole(lost).write.parquet(path)
    end = s.read.schema(lost.schema).parquet(path).limit(1).select(*(F.lit(-1).cast("long").alias("rec") if k == "rec" else F.timestamp_seconds(F.lit(10**9)).alias("at") if k == "at" else k for k in lost.columns))
    end.write.mode("append").parquet(path)
    chunks = _read(s, lost.schema, path, 64).withWatermark("at", "1 day")
    return flat(live.drain(live.stitch_stream(chunks, CONFIG, idle=60_000, event_time="at")).where("rec >= 0"))


def _live_turns(s, d):
    """A sign-up of every tenth user begins a new session; the last timeline of each recording."""
    reset = ((F.col("event_type") == "signup") & (F.col("user_id") % 10 == 0)).alias("reset")
    x = v.events(s, d).select("rec", F.col("event_id").alias("seq"), F.concat(F.lit("speaker_"), (F.col("user_id") % 4).cast("string")).alias("speaker"), "start_ms", (F.col("start_ms") + F.round(F.col("value") * 10000).cast("long")).alias("end_ms"), reset)
    last = live.drain(live.live_turns(_staged(s, x.repartition(8))), "update").groupBy("rec").agg(F.max_by(F.struct("session", "n_turns", "speakers", "active", "largest", "turns"), F.struct("upto", "session", "n_turns")).alias("x"))
    spelled = F.concat_ws(";", F.transform("x.turns", lambda t: F.concat_ws("-", t["start_ms"].cast("string"), t["end_ms"].cast("string"), t["speaker"])))
    return last.select("rec", "x.session", "x.n_turns", "x.speakers", "x.active", "x.largest", F.md5(spelled).alias("turns"))


QUERIES = {
    "stream_stitch_replayed": _replayed,
    "stream_stitch_cut_short": _cut_short,
    "stream_live_turns": _live_turns,
    "stream_speech_events": lambda s, d: live.drain(live.speech_events(_staged(s, v.frames(s, d).select("rec", "frame", "prob").repartition(12, "rec")))),
    "stream_stitch": lambda s, d: flat(live.drain(live.stitch_stream(_staged(s, _whole(c.make_chunks(v.blocks(s, d), CONFIG))), CONFIG))),
    "stream_stitch_discard": lambda s, d: flat(live.drain(live.stitch_discard_stream(_staged(s, _whole(c.make_chunks(v.blocks(s, d), CONFIG))), CONFIG))),
    "stream_stitch_tail": lambda s, d: flat(live.drain(live.stitch_discard_stream(_staged(s, _whole(c.make_chunks(v.blocks(s, d), CONFIG, True))), CONFIG))),
    "stream_timeline": lambda s, d: live.drain(live.live_timeline(_turns(s, d)), "complete"),
    "stream_event_counts": lambda s, d: live.drain(live.event_counts(_stream(s, d).withColumnRenamed("event_type", "kind")), "complete"),
    "stream_progress": lambda s, d: live.drain(live.progress(_stream(s, d).select(F.col("event_type").alias("stage"), (F.col("value") / 4).alias("pct"))), "complete"),
    "stream_utterances": lambda s, d: live.drain(live.utterances(_stream(s, d).select((F.col("user_id") % 5).alias("rec"), F.col("ts").cast("timestamp").alias("ts")), "20 minutes"), "complete").select("rec", F.unix_micros("start").alias("start_us"), "n"),
}

_F, _T = v.using("frames"), v.using("turns")
SQL = {
    "stream_stitch_replayed": f"{_F} SELECT rec, count(*) AS n, round(sum(x), 5) AS total, CASE WHEN count(*) <= 20 THEN 1 ELSE 2 END AS late FROM frames GROUP BY rec",
    # A chunk is 20 frames every 15; a recording of at most 20 is one. Frames that no chunk covers are silent.
    "stream_stitch_cut_short": f"""{_F}, t AS (SELECT rec, frame, x, count(*) OVER (PARTITION BY rec) AS n FROM frames),
c AS (SELECT *, unnest(CASE WHEN n <= 20 OR frame < 15 THEN [0] WHEN frame % 15 < 5 THEN [frame // 15 - 1, frame // 15] ELSE [frame // 15] END) AS k FROM t)
SELECT rec, frame, round(CASE WHEN bool_or(k % 3 <> 2) THEN any_value(x) ELSE 0 END, 6) AS x FROM c GROUP BY rec, frame""",
    "stream_live_turns": f"""{_T}, r AS (SELECT rec, max(event_id) AS session FROM ev WHERE event_type = 'signup' AND user_id % 10 = 0 GROUP BY rec),
o AS (SELECT t.*, coalesce(session, -1) AS session FROM turns AS t LEFT JOIN r USING (rec) WHERE turn_id > coalesce(session, -1)),
m AS (SELECT a.rec, a.start_ms, count(DISTINCT b.speaker) AS most FROM o AS a JOIN o AS b ON a.rec = b.rec AND b.start_ms <= a.start_ms AND a.start_ms < b.end_ms GROUP BY 1, 2),
g AS (SELECT rec, any_value(session) AS session, count(*) AS n_turns, count(DISTINCT speaker) AS speakers, max(start_ms) AS latest,
  md5(string_agg(start_ms || '-' || end_ms || '-' || speaker, ';' ORDER BY start_ms, end_ms, speaker)) AS turns FROM o GROUP BY rec),
z AS (SELECT DISTINCT rec FROM ev)
SELECT z.rec, coalesce(g.session, r.session) AS session, coalesce(n_turns, 0) AS n_turns, CAST(coalesce(speakers, 0) AS INTEGER) AS speakers, CAST(coalesce((SELECT most FROM m WHERE m.rec = g.rec AND m.start_ms = g.latest), 0) AS INTEGER) AS active,
  CAST(coalesce((SELECT max(most) FROM m WHERE m.rec = g.rec), 0) AS INTEGER) AS largest, coalesce(turns, md5('')) AS turns FROM z LEFT JOIN g USING (rec) LEFT JOIN r ON r.rec = z.rec""",
    "stream_speech_events": f"{_F}, x AS (SELECT rec, frame, prob >= 0.5 AS hot, coalesce(lag(prob >= 0.5) OVER (PARTITION BY rec ORDER BY frame), false) AS was FROM frames) SELECT rec, frame * 256 AS at_ms, hot AS is_speech FROM x WHERE hot <> was",
    "stream_stitch": f"{_F} SELECT rec, frame, round(x, 6) AS x FROM frames",
    "stream_stitch_discard": DISCARD,
    "stream_stitch_tail": DISCARD_TAIL,
    "stream_timeline": f"{_T} SELECT rec, count(*) AS turns, CAST(count(DISTINCT speaker) AS INTEGER) AS speakers, max(end_ms) AS end_ms FROM turns GROUP BY rec",
    "stream_event_counts": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1",
    "stream_progress": "SELECT event_type AS stage, least(100.0::DOUBLE, max(value / 4)) AS pct FROM events GROUP BY 1",
    "stream_utterances": """WITH x AS (SELECT user_id % 5 AS rec, epoch_us(ts) AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY rec ORDER BY t) <= 1200000000 THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY t) AS i FROM n) SELECT rec, min(t) AS start_us, count(*) AS n FROM i GROUP BY rec, i""",
}
