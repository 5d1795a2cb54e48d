"""Queries over sources and sinks: WAV files, reports, voice tables, timelines as text, synthetic signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import scratch
from ..operators import signals as g
from ..operators import timeline as t
from ..sources import audio as a
from ..sources import reports as r
from ..sources import views as v
from ..sources import wav as w
from .signals import flat


def stereo(s: SparkSession, d: str) -> DataFrame:
    """Each recording twice as loud on a second channel, as rows of read_wav."""
    x = v.blocks(s, d)
    both = x.withColumn("channel", F.lit(0)).unionByName(g.scale(x, -0.5).withColumn("channel", F.lit(1)))
    return both.select(F.concat(F.lit("r"), F.col("rec").cast("string")).alias("rec"), "channel", F.lit(16000).alias("sample_rate"), "block_idx", "start_frame", F.size("samples").alias("n_frames"), F.col("samples").cast("array<float>").alias("samples"), F.lit("ok").alias("status"))


def _files(s, d):
    return a.to_wav(stereo(s, d)).select(F.col("rec").alias("path"), "content")


def _pcm(s, d):
    """The same as PCM16 files, one channel: a header of 44 bytes and what pcm16 gives."""
    x = g.to_pcm16(g.reblock(v.blocks(s, d), 1 << 20)).select("rec", "samples", (F.size("samples") * 2).alias("n"))
    le = lambda c, k: F.concat(*[F.lpad(F.hex(F.expr(f"shiftright({c}, {8 * i}) & 255")), 2, "0") for i in range(k)])
    head = F.concat(F.lit("52494646"), le("n + 36", 4), F.lit("57415645666D74201000000001000100401F0000803E00000200100064617461"), le("n", 4))
    body = F.array_join(F.transform("samples", lambda p: F.concat(F.lpad(F.hex(p.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(p, 8).bitwiseAND(255)), 2, "0"))), "")
    return x.select(F.col("rec").cast("string").alias("path"), F.unhex(F.concat(head, body)).alias("content"))


def _broken(s, d):
    """Files of which some end too early, and some hold another format."""
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("int") % 4
    c = F.col("content")
    return _files(s, d).select("path", F.when(n == 0, F.expr("substring(content, 1, 10)")).when(n == 1, F.unhex(F.concat(F.substring(F.hex(c), 1, 40), F.lit("0200"), F.expr("substring(hex(content), 45)")))).otherwise(c).alias("content"))


def _staged_json(s, df):
    path = scratch(s)
    df.write.json(path)
    return path


def _reports(s, d):
    """A report for each customer with orders: a case for each order."""
    o = v.table(s, d, "orders")
    k, t_ = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    word = lambda c, n: F.when(k % 9 == n, "nan").when(k % 9 == n + 1, "-inf").otherwise(c.cast("string"))
    case = F.struct(
        k.cast("string").alias("id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("backend"), F.lit("completed").alias("status"), F.lit(16000).alias("inputSampleRate"), (k % 50 * 16000).alias("inputFrames"), F.when(k % 7 == 0, "network").otherwise("cache").alias("weightsSource"),
        F.struct(F.array(word(t_ % 100, 0), word(t_ % 10, 3)).alias("iterationSeconds"), (k % 3 / 4).cast("string").alias("stdDevSeconds")).alias("timing"),
        F.struct(t_.alias("baselineFootprintBytes"), (t_ + k % 1000 - 500).alias("afterLoadFootprintBytes"), (k % 5 * 500000).alias("mlxActiveAfterLoadBytes"), (k % 5 * 500000 + t_).alias("mlxPeakDuringRunBytes"), (k % 6 > 0).alias("weightsMaterializedAtLoad")).alias("memory"),
        F.struct((t_ % 100).cast("string").alias("userSeconds"), (k % 10).cast("string").alias("systemSeconds"), (k % 50).cast("string").alias("wallSeconds")).alias("cpu"),
        F.struct(F.lit("nominal").alias("thermalStateAtStart"), F.when(k % 5 == 0, "serious").otherwise("nominal").alias("thermalStateAtEnd"), (k % 3 == 0).alias("lowPowerModeEnabled"), F.when(k % 2 == 0, "battery").otherwise("ac").alias("powerSource")).alias("environment"),
    )
    x = o.groupBy("o_custkey").agg(F.collect_list(case).alias("results"))
    config = F.struct(F.when(F.col("o_custkey") % 2 == 0, "release").otherwise("debug").alias("buildConfiguration"), F.when(F.col("o_custkey") % 3 == 0, "in-process").otherwise("process").alias("isolation"))
    return r.read_bench_reports(s, _staged_json(s, x.select(F.col("o_custkey").cast("string").alias("runID"), config.alias("configuration"), "results")), True)


def _voice_tables(s, d):
    e = v.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    short = F.when((F.col("label") % 3 == 0) & (F.col("vec_id") % 2 == 0), F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    path = scratch(s)
    r.write_voices(e.select("label", F.format_string("v%09d", "vec_id").alias("voice_id"), short.alias("embedding")), path, "label")
    return r.read_voices(s, path, True).select("voice_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda q, x: q + x), 6).alias("total"), "error").groupBy("voice_id", "total", "error").agg(F.count("*").alias("n"))


def _spoken(s, d):
    x = v.words(s, d).withColumn("start_ms", F.col("start_ms") - F.col("start_ms") % 10)
    return x.withColumn("speaker", F.when(F.col("word_id") % 5 > 0, F.concat(F.lit("speaker_"), (F.col("word_id") % 3).cast("string"))))


def _segments(s, d):
    return v.turns(s, d).select("rec", "start_ms", "end_ms", F.concat(F.lit("seg_"), F.col("turn_id").cast("string"), F.lit(".wav")).alias("file"), F.lit("speech").alias("type"))


def _spec(s, d):
    k = F.col("c_custkey")
    kinds = F.array(*map(F.lit, ("sine", "harmonic", "silence", "noise")))
    seconds = F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, -1.0).otherwise((k % 4 + 1) / 16.0)
    return v.table(s, d, "customer").select(
        k.alias("rec"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("kind"), (k % 40 + 1).cast("double").alias("hz"), seconds.alias("seconds"), F.lit(1200).alias("rate"), F.when(k % 5 > 0, k).alias("seed"),
        F.when(k % 3 > 0, k % 3 / 4).alias("amplitude"), (k % 2 + 1).alias("channels"),
    )


def _wav_files(s, d):
    """Files written and read again, by ranges that cut most of them."""
    path = scratch(s)
    w.write_wav(stereo(s, d), path)
    return flat(g.blocks_of(w.read_wav(s, path, 24, 500).withColumn("rec", F.regexp_extract("rec", r"([^/]+)\.wav$", 1))))


QUERIES = {
    "wav_round_trip": lambda s, d: flat(g.blocks_of(a.decode_files(_files(s, d), 24))),
    "wav_files": _wav_files,
    "wav_pcm16": lambda s, d: flat(g.blocks_of(a.decode_files(_pcm(s, d)))),
    "ingest_rejects": lambda s, d: a.split_ingest(a.decode_files(_broken(s, d), 24), 70 / 16000)[1],
    "ingest_accepted": lambda s, d: a.split_ingest(a.decode_files(_broken(s, d), 24), 70 / 16000)[0].groupBy("rec", "channel").agg(F.sum("n_frames").alias("n")),
    "bench_reports": lambda s, d: _reports(s, d).select("runID", "case_id", "category", F.concat_ws(",", F.transform("seconds", lambda x: F.when(F.isnan(x), "nan").when(x == float("-inf"), "-inf").otherwise(x.cast("int").cast("string")))).alias("seconds"), "audio_seconds", "sd_s", "before_load", "after_load", "active_bytes", "peak_bytes", "materialized", "user_s", "system_s", "wall_s", "on_battery", "low_power", "thermal_after", "cold", "build", "isolated"),
    "voice_tables": _voice_tables,
    "turns_csv": lambda s, d: r.turns_csv(v.turns(s, d)).select(F.concat_ws(",", "start", "end", "speaker", "confidence").alias("line")),
    "words_csv": lambda s, d: r.words_csv(_spoken(s, d)).select(F.concat_ws(",", "start", "end", "speaker", "text").alias("line")),
    "transcripts": lambda s, d: r.render_transcript(_spoken(s, d)),
    "manifests": lambda s, d: r.segment_manifest(_segments(s, d), v.recordings(s, d)).select("rec", F.get_json_object("json", "$.sourceFile").alias("source"), F.get_json_object("json", "$.totalDuration").cast("double").alias("total"), F.size(F.from_json("json", "segments array<struct<file:string>>")["segments"]).alias("n"), F.sha2(F.concat_ws(",", F.transform(F.from_json("json", "segments array<struct<originalStart:double,originalEnd:double,file:string,type:string,durationSeconds:double>>")["segments"], lambda x: F.concat_ws("|", F.round(x["originalStart"] * 1000).cast("long").cast("string"), F.round(x["durationSeconds"] * 1000).cast("long").cast("string"), x["file"], x["type"]))), 256).alias("digest")),
    "synth_signals": lambda s, d: flat(a.synth_signals(s, _spec(s, d), 64)),
    "sort_timeline": lambda s, d: t.sort_timeline(v.turns(s, d)).withColumn("nth", F.monotonically_increasing_id()).select("turn_id", "rec", F.row_number().over(Window.partitionBy("rec").orderBy("nth")).alias("place")),
    "speaker_turns": lambda s, d: t.for_speaker(v.turns(s, d), "speaker_2").select("turn_id", "rec"),
    "speech_and_silence": lambda s, d: t.speech(v.frames(s, d).withColumn("is_speech", F.col("prob") >= 0.5)).groupBy("rec").agg(F.count("*").alias("speech")).join(t.speech(v.frames(s, d).withColumn("is_speech", F.col("prob") >= 0.5), False).groupBy("rec").agg(F.count("*").alias("silence")), "rec", "full_outer"),
}

_F, _T, _W = v.using("frames"), v.using("turns"), v.using("words", "recordings")
_SPOKEN = f"{_W}, sp AS (SELECT * REPLACE (start_ms - start_ms % 10 AS start_ms), CASE WHEN word_id % 5 > 0 THEN 'speaker_' || word_id % 3 END AS speaker FROM words)"
_SEC = lambda c: f"printf('%.3f', {c} / 1000.0::DOUBLE)"
SQL = {
    "wav_round_trip": f"{_F} SELECT 'r' || rec AS rec, channel, frame, round(CAST(CAST(CASE channel WHEN 0 THEN x ELSE -0.5::DOUBLE * x END AS FLOAT) AS DOUBLE), 6) AS x FROM frames, (SELECT unnest([0, 1]) AS channel)",
    "wav_files": f"{_F} SELECT 'r' || rec AS rec, channel, frame, round(CAST(CAST(CASE channel WHEN 0 THEN x ELSE -0.5::DOUBLE * x END AS FLOAT) AS DOUBLE), 6) AS x FROM frames, (SELECT unnest([0, 1]) AS channel)",
    "wav_pcm16": f"{_F} SELECT CAST(rec AS VARCHAR) AS rec, 0 AS channel, frame, round(CAST(CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) * 32767) / 32768.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS x FROM frames",
    "ingest_rejects": f"{_F}, n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec) SELECT 'r' || rec AS rec, CASE rec % 4 WHEN 0 THEN 'not a WAV file' WHEN 1 THEN 'neither PCM16 nor float32' ELSE 'too long' END AS reason FROM n WHERE rec % 4 < 2 OR n > 70",
    "ingest_accepted": f"{_F} SELECT 'r' || rec AS rec, channel, count(*) AS n FROM frames, (SELECT unnest([0, 1]) AS channel) WHERE rec % 4 > 1 GROUP BY ALL HAVING count(*) <= 70",
    "bench_reports": """WITH o AS (SELECT *, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS "runID", CAST(k AS VARCHAR) AS case_id, o_orderpriority AS category, (CASE k % 9 WHEN 0 THEN 'nan' WHEN 1 THEN '-inf' ELSE CAST(t % 100 AS VARCHAR) END) || ',' || (CASE k % 9 WHEN 3 THEN 'nan' WHEN 4 THEN '-inf' ELSE CAST(t % 10 AS VARCHAR) END) AS seconds,
  CAST(k % 50 AS DOUBLE) AS audio_seconds, (k % 3) / 4.0::DOUBLE AS sd_s, t AS before_load, t + k % 1000 - 500 AS after_load, k % 5 * 500000 AS active_bytes, k % 5 * 500000 + t AS peak_bytes, k % 6 > 0 AS materialized, CAST(t % 100 AS DOUBLE) AS user_s, CAST(k % 10 AS DOUBLE) AS system_s, CAST(k % 50 AS DOUBLE) AS wall_s,
  k % 2 = 0 AS on_battery, k % 3 = 0 AS low_power, CASE WHEN k % 5 = 0 THEN 'serious' ELSE 'nominal' END AS thermal_after, k % 7 = 0 AS cold, CASE WHEN o_custkey % 2 = 0 THEN 'release' ELSE 'debug' END AS build, o_custkey % 3 > 0 AS isolated FROM o""",
    "voice_tables": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), bad AS (SELECT label FROM e GROUP BY label HAVING label % 3 = 0 AND count(DISTINCT vec_id % 2) = 2)
SELECT printf('v%09d', vec_id) AS voice_id, round(list_sum(CASE WHEN label % 3 = 0 AND vec_id % 2 = 0 THEN x[1:60] ELSE x END), 6) AS total, CAST(NULL AS VARCHAR) AS error, 1 AS n FROM e WHERE label NOT IN (FROM bad)
UNION ALL SELECT NULL, NULL, 'dimensions differ', count(*) FROM bad HAVING count(*) > 0""",
    "turns_csv": f"{_T} SELECT {_SEC('start_ms')} || ',' || {_SEC('end_ms')} || ',' || speaker || ',' || printf('%.3f', conf) AS line FROM turns",
    "words_csv": f"{_SPOKEN} SELECT {_SEC('start_ms')} || ',' || {_SEC('end_ms')} || ',' || coalesce(speaker, '') || ',' || text AS line FROM sp",
    "transcripts": f"{_SPOKEN} SELECT rec, string_agg(printf('[%02d:%05.2f] Speaker %s: %s', start_ms // 60000, (start_ms % 60000) / 1000.0::DOUBLE, coalesce(speaker, 'Unknown'), text), chr(10) ORDER BY start_ms, end_ms, word_id) AS text FROM sp GROUP BY rec",
    "manifests": f"{_T} SELECT rec, CAST(rec AS VARCHAR) AS source, 86400.0::DOUBLE AS total, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(start_ms || '|' || (end_ms - start_ms) || '|seg_' || turn_id || '.wav|speech', ',' ORDER BY start_ms, end_ms, 'seg_' || turn_id || '.wav')) AS digest FROM turns GROUP BY rec",
    # The generator's states follow each other; a channel is 13 frames behind the one before it.
    "synth_signals": """WITH RECURSIVE s AS (SELECT c_custkey AS rec, c_custkey % 4 AS kind, c_custkey % 40 + 1 AS hz, CAST((c_custkey % 4 + 1) * 75 AS BIGINT) AS n, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 / 4.0::DOUBLE ELSE 0.5::DOUBLE END AS amp,
  xor(CASE WHEN c_custkey % 5 > 0 THEN c_custkey ELSE 0 END::HUGEINT, 2685821657736338717::HUGEINT) AS seed FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 13 > 0),
x AS (SELECT rec, CAST(-1 AS BIGINT) AS frame, n, seed AS state FROM s UNION ALL
  SELECT rec, frame + 1, n, xor(b, (b << 17) & 18446744073709551615::HUGEINT) FROM (SELECT rec, frame, n, xor(a, a >> 7) AS b FROM (SELECT rec, frame, n, xor(state, (state << 13) & 18446744073709551615::HUGEINT) AS a FROM x WHERE frame < n - 1) AS p) AS q),
f AS (SELECT s.*, frame, CAST(state % 2000003 AS DOUBLE) / 1000001.5::DOUBLE - 1 AS noise, frame / 1200.0::DOUBLE AS t FROM s JOIN x USING (rec) WHERE frame >= 0),
m AS (SELECT rec, frame, CASE kind WHEN 0 THEN amp * sin(2 * pi() * hz * t) WHEN 3 THEN amp * noise WHEN 1 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * (0.01::DOUBLE * noise
  + list_sum(list_transform(range(1, 5), lambda h: sin(2 * pi() * 110 * h * t + h) / h)) / 3 * (0.35::DOUBLE + 0.65::DOUBLE * abs(sin(2 * pi() * 3.5::DOUBLE * t)))))) ELSE 0 END AS x FROM f),
c AS (SELECT rec, unnest(range(rec % 2 + 1)) AS channel, n FROM s), o AS (SELECT rec, channel, unnest(range(n)) AS frame FROM c)
SELECT o.rec, CAST(channel AS INTEGER) AS channel, o.frame, round(coalesce(m.x, 0), 6) AS x FROM o LEFT JOIN m ON m.rec = o.rec AND m.frame = o.frame - 13 * channel""",
    "sort_timeline": f"{_T} SELECT turn_id, rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY start_ms, end_ms, turn_id) AS INTEGER) AS place FROM turns",
    "speaker_turns": f"{_T} SELECT turn_id, rec FROM turns WHERE speaker = 'speaker_2'",
    "speech_and_silence": f"{_F} SELECT rec, nullif(count(*) FILTER (prob >= 0.5), 0) AS speech, nullif(count(*) FILTER (prob < 0.5), 0) AS silence FROM frames GROUP BY rec",
}
