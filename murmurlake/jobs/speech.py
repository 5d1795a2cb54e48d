"""Queries over speech activity, tokens and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as g
from ..operators import vad, words
from ..sources import views as v
from .signals import flat

#: A frame of the signals is one of the detector's, 256 ms.
RATE = 1000 / 256

_CHUNKS = lambda s, d: v.frames(s, d).where("frame % 8 = 0").select("rec", (F.col("frame") / 8).cast("long").alias("chunk_idx"), (F.col("frame") * 256).alias("start_ms"), (F.col("frame") * 256 + 2048).alias("end_ms"))
_VAD = lambda s, d: vad.segments_from_probs(v.frames(s, d))
_MASK = lambda s, d: vad.frame_mask(v.frames(s, d), _TOTAL(s, d).withColumnRenamed("total_ms", "duration_ms"), 0.9)
_TOTAL = lambda s, d: v.frames(s, d).groupBy("rec").agg((F.count("*") * 256).alias("total_ms"))



def _phones(s, d):
    """Tokens of three kinds by event, and a duration for each event of the same user."""
    e = v.frames(s, d).select(F.col("rec").alias("utt"), F.col("frame").cast("int").alias("idx"), "x")
    tokens = e.select("utt", "idx", F.when(F.col("idx") % 5 == 3, F.lit(None)).otherwise(F.repeat(F.lit("p"), (F.col("idx") % 3).cast("int"))).alias("phones"), (F.col("idx") % 2 == 0).alias("is_space"))
    durations = e.groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda t: F.floor(t["x"] * 10).cast("double")).alias("durations"))
    return tokens, durations


QUERIES = {
    "vad_segments": _VAD,
    "frame_mask": lambda s, d: vad.frame_mask(v.frames(s, d), _TOTAL(s, d).withColumnRenamed("total_ms", "duration_ms"), 0.9).groupBy("rec").agg(F.count("*").alias("n"), F.sum("i").alias("total")),
    "speech_bounds": lambda s, d: vad.speech_bounds(_VAD(s, d), _TOTAL(s, d)),
    "resample_mask": lambda s, d: v.table(s, d, "events").select("event_id", vad.resample_mask(F.transform(F.sequence(F.lit(0), F.col("event_id") % 7), lambda i: i * i), F.col("user_id") % 5 + 1).alias("m")).select("event_id", F.concat_ws(",", F.transform("m", lambda x: x.cast("string"))).alias("mask")),
    "gate_chunks": lambda s, d: vad.gate_chunks(_CHUNKS(s, d), _VAD(s, d)).select("rec", "chunk_idx", "batch_id"),
    "concat_ranges": lambda s, d: flat(vad.concat_ranges(v.blocks(s, d), _VAD(s, d), RATE, 32)),
    "trim_by_segments": lambda s, d: flat(vad.trim_by_segments(v.blocks(s, d), _VAD(s, d), RATE, 300)),
    "trim_to_speech": lambda s, d: flat(vad.trim_to_speech(v.blocks(s, d), _MASK(s, d), RATE)[0]),
    "trimmed_mask": lambda s, d: vad.trim_to_speech(v.blocks(s, d), _MASK(s, d), RATE)[1].groupBy("rec").agg(F.count("*").alias("n"), F.sum("i").alias("total")),
    "process_gated": lambda s, d: flat(vad.process_gated(v.blocks(s, d), _VAD(s, d), RATE, lambda x: g.scale(x, -2.0), 32)),
    "merge_tokens": lambda s, d: words.merge_tokens_into_words(v.tokens(s, d)).withColumn("confidence", F.round("confidence", 6)).drop("word_no"),
    "words_with_fallback": lambda s, d: words.with_fallback(words.merge_tokens_into_words(v.tokens(s, d).withColumn("token", F.when(F.col("rec") % 3 == 0, F.col("token")).otherwise(F.lit(" ")))), v.table(s, d, "benchmark").select(F.col("item_id").alias("rec"), "text", (F.length("text") * 160).alias("n_samples"))).groupBy("rec").agg(F.count("*").alias("n"), F.max("end_ms").alias("end_ms")),
    "merge_token_windows": lambda s, d: words.merge_token_windows(v.events(s, d).groupBy(F.col("user_id").alias("rec"), F.floor(F.col("event_id") / 500).alias("window_idx")).agg(F.sort_array(F.collect_list("event_id")).alias("ids")), 4, 1).select("rec", F.size("ids").alias("n"), F.when(F.size("ids") > 0, F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))).alias("ids")),
    "word_times": lambda s, d: words.word_times(*_phones(s, d)).select("utt", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end")),
    "word_labels": lambda s, d: words.word_labels(v.tokens(s, d).select("rec", "idx", (~F.col("token").rlike("^[ \n\t]")).alias("is_subword"), F.array(F.col("confidence"), 1.1 - F.col("confidence"), F.lit(0.5)).alias("scores")), ["up", "down", "flat"]),
}

_B = v.using("frames")
_V = r"""sp AS (SELECT rec, frame, frame * 256 AS s, (frame + 1) * 256 AS e FROM frames WHERE prob >= 0.5),
si AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY frame) AS i FROM (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY rec ORDER BY frame) < 400 THEN 0 ELSE 1 END AS new FROM sp)),
vad AS (SELECT rec, min(s) AS start_ms, max(e) AS end_ms FROM si GROUP BY rec, i HAVING max(e) - min(s) >= 250),
total AS (SELECT rec, count(*) * 256 AS total_ms FROM frames GROUP BY rec)"""
_M = """m AS (SELECT DISTINCT rec, unnest(range(CAST(frame * 256 // 17 AS BIGINT), CAST(least((frame + 1) * 256 // 17, n * 256 // 17) AS BIGINT))) AS i FROM frames JOIN (SELECT rec, count(*) AS n FROM frames GROUP BY rec) USING (rec) WHERE prob >= 0.9),
total AS (SELECT rec, count(*) AS n, count(*) * 256 AS total_ms FROM frames GROUP BY rec),
cuts AS (SELECT *, CASE WHEN fits THEN lo_ ELSE 0 END AS lo, CASE WHEN fits THEN hi_ ELSE n END AS hi FROM (SELECT *, coalesce(lo_ < hi_, false) AS fits FROM
  (SELECT total.rec, n, a, CAST(floor(a * 17 / 256.0::DOUBLE) AS BIGINT) AS lo_, least(n, CAST(floor((b + 1) * 17 / 256.0::DOUBLE) AS BIGINT)) AS hi_ FROM total LEFT JOIN (SELECT rec, min(i) AS a, max(i) AS b FROM m GROUP BY rec) e ON total.rec = e.rec)))"""
_T = v.using("tokens")
_W = r"""tw AS (SELECT *, sum(CASE WHEN regexp_matches(token, '^[ \n\t]') THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY idx) AS w FROM tokens),
wd AS (SELECT rec, w, string_agg(trim(token, E' \n\t\r'), '' ORDER BY idx) AS word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, avg(confidence) AS confidence FROM tw GROUP BY rec, w)"""

SQL = {
    "vad_segments": f"{_B}, {_V} SELECT * FROM vad",
    "frame_mask": f"{_B}, {_V}, m AS (SELECT DISTINCT rec, unnest(range(CAST(frame * 256 // 17 AS BIGINT), CAST(least((frame + 1) * 256 // 17, total_ms // 17) AS BIGINT))) AS i FROM frames JOIN total USING (rec) WHERE prob >= 0.9) SELECT rec, count(*) AS n, CAST(sum(i) AS BIGINT) AS total FROM m GROUP BY rec",
    "speech_bounds": f"{_B}, {_V} SELECT t.rec, coalesce(min(start_ms), 0) AS start_ms, coalesce(least(max(end_ms) + 10, total_ms), total_ms) AS end_ms FROM total t LEFT JOIN vad v ON t.rec = v.rec GROUP BY t.rec, total_ms",
    "resample_mask": "SELECT event_id, array_to_string(list_transform(range(user_id % 5 + 1), lambda i: least(i * (event_id % 7 + 1) // (user_id % 5 + 1), event_id % 7) * least(i * (event_id % 7 + 1) // (user_id % 5 + 1), event_id % 7)), ',') AS mask FROM events",
    "gate_chunks": f"{_B}, {_V}, c AS (SELECT rec, frame // 8 AS chunk_idx, frame * 256 AS s, frame * 256 + 2048 AS e FROM frames WHERE frame % 8 = 0), k AS (SELECT DISTINCT c.rec, chunk_idx FROM c JOIN vad v ON c.rec = v.rec AND s < end_ms AND e > start_ms) SELECT rec, chunk_idx, (row_number() OVER (PARTITION BY rec ORDER BY chunk_idx) - 1) // 40 AS batch_id FROM k",
    "concat_ranges": f"{_B}, {_V}, k AS (SELECT DISTINCT f.rec, frame, x FROM frames f JOIN vad v ON f.rec = v.rec AND frame * 256 < end_ms AND (frame + 1) * 256 > start_ms) SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY frame) - 1 AS frame, round(x, 6) AS x FROM k",
    "trim_by_segments": f"{_B}, {_V}, e AS (SELECT t.rec, coalesce(min(start_ms) // 256, 0) AS lo, coalesce(least(max(end_ms) + 300, total_ms) // 256, total_ms // 256) AS hi FROM total t LEFT JOIN vad v ON t.rec = v.rec GROUP BY t.rec, total_ms) SELECT rec, frame - lo AS frame, round(x, 6) AS x FROM frames JOIN e USING (rec) WHERE frame >= lo AND frame < hi",
    "trim_to_speech": f"{_B}, {_M} SELECT rec, frame - lo AS frame, round(x, 6) AS x FROM frames JOIN cuts USING (rec) WHERE frame >= lo AND frame < hi",
    "trimmed_mask": f"{_B}, {_M}, k AS (SELECT m.rec, i - a AS i FROM m JOIN cuts c ON m.rec = c.rec AND fits UNION ALL SELECT rec, unnest(range(CAST(total_ms // 17 AS BIGINT))) FROM cuts JOIN total USING (rec) WHERE NOT fits) SELECT rec, count(*) AS n, CAST(sum(i) AS BIGINT) AS total FROM k GROUP BY rec",
    "process_gated": f"{_B}, {_V} SELECT f.rec, frame, round(CASE WHEN EXISTS (SELECT 1 FROM vad v WHERE v.rec = f.rec AND frame * 256 >= start_ms AND frame * 256 < end_ms) THEN -2 * x ELSE x END, 6) AS x FROM frames f",
    "word_times": f"""{_B}, d AS (SELECT rec AS utt, list(floor(x * 10) ORDER BY frame) AS d FROM frames GROUP BY rec),
t AS (SELECT rec AS utt, CAST(frame AS INTEGER) AS idx, CASE WHEN frame % 5 = 3 THEN NULL ELSE frame % 3 END AS n, frame % 2 = 0 AS sp FROM frames),
p AS (SELECT t.*, d, 1 + coalesce(sum(CASE WHEN n IS NULL THEN CASE WHEN sp THEN 2 ELSE 0 END ELSE n + CASE WHEN sp THEN 1 ELSE 0 END END) OVER (PARTITION BY utt ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM t JOIN d USING (utt) WHERE len(d) >= 3),
s AS (SELECT *, min(CASE WHEN i >= len(d) - 1 OR i + n >= len(d) THEN idx END) OVER (PARTITION BY utt) AS stop FROM p),
c AS (SELECT utt, idx, n, sp, d, coalesce(list_sum(list_slice(d, i + 1, i + n)), 0) AS said, CASE WHEN sp THEN d[CAST(CASE WHEN n IS NULL THEN i + 2 ELSE i + n + 1 END AS BIGINT)] ELSE 0 END AS rest FROM s WHERE stop IS NULL OR idx < stop),
k AS (SELECT *, 2 * greatest(0, d[1] - 3) + coalesce(sum(2 * (said + rest)) OVER (PARTITION BY utt ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clock FROM c WHERE n IS NOT NULL OR sp)
SELECT utt, idx, round(start, 6) AS start, round("end", 6) AS "end" FROM (SELECT utt, idx, n, coalesce(lag(clock + 2 * said + rest) OVER (PARTITION BY utt ORDER BY idx), clock) / 80 AS start, (clock + 2 * said + rest) / 80 AS "end" FROM k) WHERE n IS NOT NULL""",
    "merge_tokens": f"{_T}, {_W} SELECT rec, word, start_ms, end_ms, round(confidence, 6) AS confidence FROM wd WHERE word <> ''",
    "words_with_fallback": f"{_T}, {_W} SELECT item_id AS rec, CASE WHEN item_id % 3 = 0 THEN (SELECT count(*) FROM wd WHERE wd.rec = item_id AND word <> '') ELSE 1 END AS n, CASE WHEN item_id % 3 = 0 THEN (SELECT max(end_ms) FROM wd WHERE wd.rec = item_id AND word <> '') ELSE length(text) * 10 END AS end_ms FROM benchmark",
    "merge_token_windows": """WITH x AS (SELECT user_id AS rec, event_id // 500 AS w, list_sort(list(event_id)) AS ids FROM events GROUP BY ALL),
y AS (SELECT *, w > min(w) OVER (PARTITION BY rec) AS inner_l, w < max(w) OVER (PARTITION BY rec) AS inner_r FROM x),
z AS (SELECT rec, w, list_slice(ids, CASE WHEN inner_l THEN 3 ELSE 1 END, greatest(0, len(ids) - CASE WHEN inner_r THEN 2 ELSE 0 END)) AS ids FROM y)
SELECT rec, CAST(sum(len(ids)) AS INTEGER) AS n, string_agg(array_to_string(ids, ','), ',' ORDER BY w) FILTER (len(ids) > 0) AS ids FROM z GROUP BY rec""",
    "word_labels": f"""{_T}, {_W}, s AS (SELECT rec, w AS word_no, unnest([confidence, 1.1::DOUBLE - confidence, 0.5::DOUBLE]) AS p, unnest(['up', 'down', 'flat']) AS label, unnest([0, 1, 2]) AS k FROM tw),
m AS (SELECT rec, word_no, k, label, round(avg(p), 9) AS p FROM s GROUP BY ALL) SELECT rec, CAST(word_no AS BIGINT) AS word_no, arg_min(label, (-p, k)) AS label FROM m GROUP BY rec, word_no""",
}
