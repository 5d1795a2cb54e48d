"""Queries over timelines of turns and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import intersection, overlaps, slot_of
from ..operators import timeline as t
from ..sources import views as v

QUERIES = {
    "talk_time": lambda s, d: t.talk_time(t.attribute_words(v.words(s, d), v.turns(s, d))).withColumn("confidence", F.round("confidence", 6)),
    "attribute_words": lambda s, d: t.attribute_words(v.words(s, d), v.turns(s, d)).select("rec", "word_id", "speaker", F.concat_ws(",", "active").alias("active"), F.round("confidence", 6).alias("confidence")),
    "overlapping_ranges": lambda s, d: t.overlapping_ranges(v.turns(s, d)),
    "max_overlapping_speakers": lambda s, d: t.max_overlapping_speakers(v.turns(s, d)),
    "speaker_counts": lambda s, d: t.speaker_counts(v.turns(s, d)),
    "range_speakers": lambda s, d: t.range_speakers(t.overlapping_ranges(v.turns(s, d)), v.turns(s, d)),
    "route_models": lambda s, d: t.routed(t.concurrency(v.turns(s, d)).where("n >= 2")).groupBy("model").agg(F.count("*").alias("ranges"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")),
    "speech_gaps": lambda s, d: t.gaps(v.turns(s, d), v.recordings(s, d)),
    "speech_share": lambda s, d: t.speech_share(v.turns(s, d), v.recordings(s, d)).withColumn("pct", F.round("pct", 6)),
    "uncertain_words": lambda s, d: t.uncertain(t.attribute_words(v.words(s, d), v.turns(s, d))).groupBy("rec").agg(F.count("*").alias("n_words"), F.count_distinct("speaker").alias("n_speakers")),
    "dominant_speaker": lambda s, d: t.dominant_speaker(v.turns(s, d).withColumn("track", F.col("rec") * 100 + F.col("user_id") % 7)).withColumn("conf", F.round("conf", 6)),
    "identify_slot": lambda s, d: t.identify_slot(v.events(s, d).select(F.col("user_id").alias("track"), F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.when(i == F.col("event_id") % 4, F.col("value") / 500).otherwise(0.1)).alias("probs")), 6).select("track", "slot", F.round("conf", 6).alias("conf"), F.concat_ws(",", F.transform("probs", lambda p: F.format_number(p, 6))).alias("probs")),
    "order_tracks": lambda s, d: t.order_tracks(v.turns(s, d).select("rec", F.col("turn_id").alias("track"), F.when(F.col("user_id") % 3 > 0, slot_of(F.col("speaker"))).alias("slot"))),
    "map_slots": lambda s, d: t.map_slots(v.words(s, d).select("rec", F.col("word_id").alias("track"), (F.col("word_id") % 4).cast("int").alias("slot"), "start_ms", "end_ms"), v.turns(s, d)),
    "compare_diarizers": lambda s, d: t.compare_diarizers(v.turns(s, d), v.turns(s, d).withColumn("speaker", F.concat(F.lit("speaker_"), (F.col("user_id") % 9).cast("string"))).withColumn("start_ms", F.col("start_ms") + F.when(F.col("turn_id") % 3 == 0, 60_000).otherwise(0))),
    "timeline_from_slots": lambda s, d: t.timeline_from_slots(*(v.turns(s, d).where(f"turn_id % 5 {k} 0").select("rec", slot_of(F.col("speaker")).alias("slot"), "start_ms", "end_ms") for k in ("<>", "="))),
    "merge_branches": lambda s, d: t.merge_branches(
        t.speaker_counts(v.turns(s, d)).select("rec", F.col("n").alias("speakers"), F.lit(None).cast("bigint").alias("speech_ms")),
        t.speech_share(v.turns(s, d), v.recordings(s, d)).where("rec % 2 = 0").select("rec", "speech_ms"),
        t.max_overlapping_speakers(v.turns(s, d)).where("rec % 3 = 0").select("rec", F.col("n").cast("bigint").alias("speakers")),
    ),
    "valid_segments": lambda s, d: t.valid_segments(v.events(s, d).select("event_id", F.when(F.col("event_id") % 11 == 0, "  ").otherwise(F.col("event_type")).alias("text"), (F.col("start_ms") / 1000 - 100).alias("start"), F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("duration"))).select("event_id", "text"),
    "confident_turns": lambda s, d: t.confident(v.turns(s, d).where(slot_of(F.col("speaker")).isNotNull()), 0.5).groupBy("rec", "speaker").agg(F.count("*").alias("n")),
    "validate_format": lambda s, d: t.validate_format(v.turns(s, d).select("turn_id", F.when(F.col("turn_id") % 5 == 0, 48000).otherwise(16000).alias("sample_rate"), (F.col("turn_id") % 3).alias("channels"), F.col("end_ms").alias("n_samples")), 16000, 2)[1].groupBy("reason").agg(F.count("*").alias("n")),
    "turn_intersections": lambda s, d: v.turns(s, d).alias("a").join(v.turns(s, d).alias("b"), (F.col("a.rec") == F.col("b.rec")) & (F.col("a.turn_id") + 1 == F.col("b.turn_id"))).select(F.col("a.turn_id").alias("turn_id"), overlaps(F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.start_ms"), F.col("b.end_ms")).alias("overlaps"), intersection(F.col("a.start_ms"), F.col("a.end_ms"), F.col("b.start_ms"), F.col("b.end_ms")).alias("x")).select("turn_id", "overlaps", F.col("x.start").alias("start_ms"), F.col("x.end").alias("end_ms")),
}

_MET = """met AS (SELECT w.rec, w.word_id, t.speaker, sum(least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms)) AS ms, max(t.conf) AS conf
  FROM words w JOIN turns t ON w.rec = t.rec AND w.start_ms < t.end_ms AND w.end_ms > t.start_ms GROUP BY ALL HAVING sum(least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms)) > 0),
best AS (SELECT rec, word_id, arg_min(speaker, (-ms, speaker)) AS speaker, arg_min(conf, (-ms, speaker)) AS conf, max(ms) AS ms, sum(ms) AS all_ms, count(*) AS n, string_agg(speaker, ',' ORDER BY speaker) AS active FROM met GROUP BY ALL),
attributed AS (SELECT w.*, b.speaker, coalesce(b.active, '') AS active, coalesce(b.n, 0) AS n,
  coalesce(CASE WHEN b.n = 1 THEN 1.0::DOUBLE ELSE b.ms / greatest(b.all_ms, 1)::DOUBLE END * b.conf, 0.0::DOUBLE) AS confidence FROM words w LEFT JOIN best b USING (rec, word_id))"""

_SWEEP = """isl AS (SELECT rec, speaker, start_ms, end_ms, sum(new) OVER (PARTITION BY rec, speaker ORDER BY start_ms, end_ms, turn_id ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY rec, speaker ORDER BY start_ms, end_ms, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {turns} WHERE end_ms > start_ms)),
mrg AS (SELECT rec, min(start_ms) AS s, max(end_ms) AS e FROM isl GROUP BY rec, speaker, i),
net AS (SELECT rec, t, sum(d) AS d FROM (SELECT rec, s AS t, 1 AS d FROM mrg UNION ALL SELECT rec, e, -1 FROM mrg) GROUP BY rec, t),
conc AS (SELECT * FROM (SELECT rec, t AS start_ms, lead(t) OVER (PARTITION BY rec ORDER BY t) AS end_ms, CAST(sum(d) OVER (PARTITION BY rec ORDER BY t) AS BIGINT) AS n FROM net) WHERE end_ms IS NOT NULL)"""
_RANGES = """rng AS (SELECT rec, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY start_ms) AS i
  FROM (SELECT *, CASE WHEN start_ms = lag(end_ms) OVER (PARTITION BY rec ORDER BY start_ms) THEN 0 ELSE 1 END AS new FROM conc WHERE n >= 2)) GROUP BY rec, i)"""
_BASE = v.using("turns", "words", "recordings")
_SW = f"{_BASE}, {_SWEEP.format(turns='turns')}"


def _summary(name: str, select: str) -> str:
    x = _SWEEP.format(turns=f"turns_{name}")
    for k in ("isl", "mrg", "net", "conc"):
        x = x.replace(f"{k} AS (", f"{k}_{name} AS (").replace(f"FROM {k} ", f"FROM {k}_{name} ").replace(f"FROM {k})", f"FROM {k}_{name})").replace(f"FROM {k} U", f"FROM {k}_{name} U")
    return f"turns_{name} AS ({select}), {x}, sum_{name} AS (SELECT t.rec, count(DISTINCT speaker) AS speakers_{name}, count(*) AS segments_{name}, (SELECT max(n) FROM conc_{name} c WHERE c.rec = t.rec) AS max_overlap_{name} FROM turns_{name} t GROUP BY t.rec)"


SQL = {
    "talk_time": f"{_BASE}, {_MET} SELECT rec, speaker, count(*) AS n_words, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, round(avg(confidence), 6) AS confidence FROM attributed GROUP BY ALL",
    "attribute_words": f"{_BASE}, {_MET} SELECT rec, word_id, speaker, active, round(confidence, 6) AS confidence FROM attributed",
    "overlapping_ranges": f"{_SW}, {_RANGES} SELECT * FROM rng",
    "max_overlapping_speakers": f"{_SW} SELECT rec, max(n) AS n FROM conc GROUP BY rec",
    "speaker_counts": f"{_BASE} SELECT rec, count(DISTINCT speaker) AS n FROM turns GROUP BY rec",
    "range_speakers": f"{_SW}, {_RANGES} SELECT g.rec, g.start_ms, g.end_ms, count(DISTINCT t.speaker) AS n FROM rng g JOIN turns t ON g.rec = t.rec AND g.start_ms < t.end_ms AND g.end_ms > t.start_ms GROUP BY ALL",
    "route_models": f"{_SW} SELECT CASE n WHEN 2 THEN 'separate_2_noisy' WHEN 3 THEN 'separate_3' END AS model, count(*) AS ranges, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM conc WHERE n >= 2 GROUP BY 1",
    "speech_gaps": f"""{_BASE} SELECT rec, start_ms, end_ms FROM (
  SELECT rec, coalesce(max(end_ms) OVER (PARTITION BY rec ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ms, least(start_ms, 86400000) AS end_ms FROM turns
  UNION ALL SELECT rec, max(end_ms), 86400000 FROM turns GROUP BY rec) WHERE end_ms > start_ms""",
    "speech_share": f"{_BASE} SELECT rec, total_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, round(100 * sum(end_ms - start_ms) / total_ms::DOUBLE, 6) AS pct FROM turns JOIN recordings USING (rec) GROUP BY rec, total_ms",
    "uncertain_words": f"{_BASE}, {_MET} SELECT rec, count(*) AS n_words, count(DISTINCT speaker) AS n_speakers FROM attributed WHERE n > 1 GROUP BY rec",
    "dominant_speaker": f"{_BASE}, e AS (SELECT rec * 100 + user_id % 7 AS track, speaker, sum(end_ms - start_ms) AS ms FROM turns GROUP BY ALL) SELECT track, arg_min(speaker, (-ms, speaker)) AS speaker, CASE WHEN sum(ms) > 0 THEN round(max(ms) / sum(ms)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS conf FROM e GROUP BY track",
    "identify_slot": """WITH p AS (SELECT user_id AS track, s AS slot, round(avg(CASE WHEN event_id % 4 = s THEN value / 500 ELSE 0.1::DOUBLE END), 6) AS p FROM events, (SELECT unnest(range(4)) AS s) GROUP BY ALL)
SELECT track, CAST(arg_max(slot, (p, -slot)) AS INTEGER) AS slot, max(p) AS conf, string_agg(printf('%.6f', p), ',' ORDER BY slot) AS probs FROM p GROUP BY track""",
    "order_tracks": f"{_BASE}, x AS (SELECT rec, turn_id AS track, CASE WHEN user_id % 3 > 0 THEN CAST(user_id % 4 AS INTEGER) END AS slot FROM turns) SELECT *, CAST(row_number() OVER (PARTITION BY rec ORDER BY coalesce(slot, 999), track) AS INTEGER) AS place FROM x",
    "map_slots": f"{_BASE} SELECT w.rec, w.word_id AS track, CAST(w.word_id % 4 AS INTEGER) AS slot, w.start_ms, w.end_ms, max(t.speaker) AS speaker FROM words w LEFT JOIN turns t ON w.rec = t.rec AND w.start_ms < t.end_ms AND w.end_ms > t.start_ms AND t.speaker = 'speaker_' || (w.word_id % 4) GROUP BY ALL",
    "compare_diarizers": f"{_BASE}, {_summary('a', 'SELECT * FROM turns')}, {_summary('b', "SELECT * REPLACE ('speaker_' || user_id % 9 AS speaker, start_ms + CASE WHEN turn_id % 3 = 0 THEN 60000 ELSE 0 END AS start_ms) FROM turns")} SELECT * FROM sum_a FULL OUTER JOIN sum_b USING (rec)",
    "timeline_from_slots": f"{_BASE} SELECT rec, speaker, start_ms, end_ms, turn_id % 5 <> 0 AS is_final FROM turns",
    "merge_branches": f"{_SW} SELECT t.rec, CASE WHEN t.rec % 3 = 0 THEN (SELECT max(n) FROM conc c WHERE c.rec = t.rec) ELSE count(DISTINCT speaker) END AS speakers, CASE WHEN t.rec % 2 = 0 THEN CAST(sum(end_ms - start_ms) AS BIGINT) END AS speech_ms FROM turns t GROUP BY t.rec",
    "valid_segments": f"{_BASE} SELECT event_id, event_type AS text FROM ev WHERE event_id % 11 <> 0 AND event_id % 7 <> 0 AND start_ms / 1000.0::DOUBLE >= 100",
    "confident_turns": f"{_BASE} SELECT rec, speaker, count(*) AS n FROM turns WHERE conf >= 0.5 GROUP BY ALL",
    "validate_format": f"{_BASE}, r AS (SELECT CASE WHEN turn_id % 3 = 0 THEN 'not a signal' WHEN end_ms % (turn_id % 3) <> 0 THEN 'samples are not whole frames' WHEN turn_id % 5 = 0 THEN 'sample rate' WHEN turn_id % 3 <> 2 THEN 'channels' END AS reason FROM turns) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "turn_intersections": f"{_BASE} SELECT a.turn_id, a.start_ms < b.end_ms AND a.end_ms > b.start_ms AS overlaps, CASE WHEN least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) THEN greatest(a.start_ms, b.start_ms) END AS start_ms, CASE WHEN least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) THEN least(a.end_ms, b.end_ms) END AS end_ms FROM turns a JOIN turns b ON a.rec = b.rec AND a.turn_id + 1 = b.turn_id",
}
