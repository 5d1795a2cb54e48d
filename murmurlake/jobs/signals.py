"""Queries over signals in blocks and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as c
from ..operators import signals as g
from ..sources import views as v

CONFIG = c.ChunkConfig(1.0, 0.25, "triangular", 20)


def flat(signals, digits=6):
    """A row for each frame."""
    own = g.keys(signals)
    return signals.select(*own, F.posexplode("samples").alias("i", "x"), "start_frame").select(*own, (F.col("start_frame") + F.col("i")).alias("frame"), F.round(F.col("x").cast("double"), digits).alias("x"))


def _half(s, d):
    return g.scale(v.blocks(s, d), 0.5)


def _totals(s, d):
    return g.lengths(v.blocks(s, d)).withColumnRenamed("n", "total")


_RANGES = lambda s, d: v.frames(s, d).groupBy("rec").agg(F.lit(0.7).alias("start"), (F.max("frame") / 10 - 1.3).alias("end"))

QUERIES = {
    "signal_levels": lambda s, d: g.levels(v.blocks(s, d)).select("rec", *(F.round(k, 6).alias(k) for k in ("rms", "peak", "dc", "dur"))),
    "slice_signal": lambda s, d: flat(g.slice_signal(v.blocks(s, d), _RANGES(s, d), 10)),
    "replace_range": lambda s, d: flat(g.replace_range(v.blocks(s, d), v.frames(s, d).select("rec").distinct().select("rec", F.lit(5).cast("long").alias("lo"), F.lit(21).cast("long").alias("hi")), g.scale(v.blocks(s, d).where("block_idx = 0 AND rec % 3 = 0"), -1.0))),
    "subtract_signals": lambda s, d: flat(g.subtract(v.blocks(s, d), _half(s, d))),
    "mix_signals": lambda s, d: flat(g.mix(v.blocks(s, d), _half(s, d), -7, 16)),
    "append_signals": lambda s, d: flat(g.append(v.blocks(s, d), _half(s, d))),
    "pcm16": lambda s, d: g.to_pcm16(g.scale(v.blocks(s, d), 3.0)).select("rec", "block_idx", F.array_max("samples").alias("top"), F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")),
    "normalize_peak": lambda s, d: g.levels(g.normalize(v.blocks(s, d), "peak", -3.0)).select("rec", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak")),
    "normalize_rms": lambda s, d: g.levels(g.normalize(v.blocks(s, d), "rms", -6.0)).select("rec", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak")),
    "snr": lambda s, d: g.snr(v.blocks(s, d), _half(s, d)).select("rec", F.round("db", 6).alias("db")),
    "signal_correlation": lambda s, d: g.correlation(v.blocks(s, d), v.blocks(s, d).withColumn("samples", F.reverse("samples"))).select("rec", F.round("value", 6).alias("value")),
    "tone_energy": lambda s, d: g.tone_energy(v.blocks(s, d), 3.0, 40.0).select("rec", F.round("energy", 6).alias("energy")),
    "mono": lambda s, d: flat(g.mono(v.blocks(s, d).withColumn("channel", F.lit(0)).unionByName(g.scale(v.blocks(s, d), 3.0).withColumn("channel", F.lit(1))))),
    "signal_qa": lambda s, d: g.qa(v.blocks(s, d), v.blocks(s, d).where("rec % 4 <> 1 OR block_idx = 0").withColumn("samples", F.transform("samples", lambda x, i: F.when((F.col("rec") % 5 == 0) & (i == 3), float("nan")).when(F.col("rec") % 4 == 2, x * 0.001).when(F.col("rec") % 4 == 3, x * 0.9).otherwise(x))), 20, 20).select("rec", F.concat_ws(",", "problems").alias("problems")),
    "fit_length": lambda s, d: v.blocks(s, d).select("rec", "block_idx", F.round(F.aggregate(g.fit_length(F.col("samples"), 20, "cycle"), F.lit(0.0), lambda a, x: a + x), 6).alias("cycle"), F.round(F.aggregate(g.fit_length(F.col("samples"), 12), F.lit(0.0), lambda a, x: a + x), 6).alias("zero")),
    "chunk_plan": lambda s, d: c.chunk_plan(_totals(s, d), CONFIG).drop("total"),
    "chunk_plan_discard": lambda s, d: c.chunk_plan(_totals(s, d), CONFIG, True).drop("total"),
    "make_chunks": lambda s, d: c.make_chunks(v.blocks(s, d), CONFIG).select("rec", "chunk_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size("samples").alias("n")),
    **{f"stitch_{b}": (lambda s, d, b=b: flat(c.stitch(c.make_chunks(v.blocks(s, d), CONFIG), CONFIG, b))) for b in ("none", "discard", "triangular", "hann")},
    "stitch_discard_tail": lambda s, d: flat(c.stitch(c.make_chunks(v.blocks(s, d), CONFIG, True), CONFIG, "discard")),
    "stitch_hann_plain": lambda s, d: flat(c.stitch(c.make_chunks(v.blocks(s, d), CONFIG), CONFIG, "hann", False)),
    "stitch_blend": lambda s, d: flat(c.stitch(c.make_chunks(v.blocks(s, d), CONFIG).withColumn("samples", F.transform("samples", lambda x: x * 0 + F.col("chunk_idx"))), CONFIG, "triangular")),
    "resample_linear": lambda s, d: g.resample(v.blocks(s, d), 10, 20, "fast", 32).select("rec", F.posexplode("samples").alias("i", "x"), "start_frame").select("rec", (F.col("start_frame") + F.col("i")).alias("frame"), F.round("x", 6).alias("x")),
    "best_lag": lambda s, d: g.best_lag(v.blocks(s, d), g.shifted(v.blocks(s, d), 3), 8, 64),
    "bandwidth": lambda s, d: g.bandwidth(v.blocks(s, d), 16000, 0.99, 16, 8, 32).select("rec", F.round("f_high", 3).alias("f_high"), "passthrough"),
    "trim_silence": lambda s, d: g.trim_silence(v.blocks(s, d), 20, 8, 4, 32),
}

_F = v.using("frames")
_BLOCK = "b AS (SELECT *, frame // 16 AS k FROM frames)"
_PLAN = "tot AS (SELECT rec, count(*) AS total FROM frames GROUP BY rec), plan AS (SELECT rec, total, unnest(CASE WHEN total <= 20 THEN [0] ELSE range(0, total, 15) END) AS start_frame FROM tot)"
_SAME = f"{_F} SELECT rec, frame, round(x, 6) AS x FROM frames"
#: Under the usual plan only a single chunk leaves its tail silent; under the other one, the last chunk does.
DISCARD = f"{_F}, n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec) SELECT rec, frame, CASE WHEN n <= 20 AND frame >= 18 THEN 0.0::DOUBLE ELSE round(x, 6) END AS x FROM frames JOIN n USING (rec)"
DISCARD_TAIL = f"{_F}, n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec) SELECT rec, frame, CASE WHEN frame >= CASE WHEN n <= 20 THEN 0 ELSE (n - 5) // 15 * 15 END + 18 THEN 0.0::DOUBLE ELSE round(x, 6) END AS x FROM frames JOIN n USING (rec)"
#: Frames of 8 around every 4th sample over mirrored ends; from the first loud one to the end of the last one's 8 samples.
TRIM = """n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec), h AS (SELECT rec, n, 4 * unnest(range(n // 4 + 1)) AS hop FROM n WHERE n > 4),
q AS (SELECT rec, n, hop, CASE WHEN p < 0 THEN -p WHEN p >= n THEN 2 * (n - 1) - p ELSE p END AS p FROM (SELECT rec, n, hop, hop + unnest(range(-4, 4)) AS p FROM h)),
e AS (SELECT q.rec, n, hop, 20 * log10(greatest(sqrt(avg(x * x)), 1e-10)) AS db FROM q JOIN frames f ON q.rec = f.rec AND q.p = f.frame GROUP BY ALL),
loud AS (SELECT rec, min(hop) AS lo, least(max(hop) + 8, max(n)) AS hi FROM (SELECT *, max(db) OVER (PARTITION BY rec) AS top FROM e) WHERE db > top - 20 GROUP BY rec),
cuts AS (SELECT n.rec, CASE WHEN lo < hi THEN lo ELSE 0 END AS lo, CASE WHEN lo < hi THEN hi ELSE n END AS hi FROM n LEFT JOIN loud ON n.rec = loud.rec)"""
SQL = {
    "signal_levels": f"{_F} SELECT rec, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS peak, round(avg(x), 6) AS dc, count(*)::DOUBLE AS dur FROM frames GROUP BY rec",
    "slice_signal": f"{_F}, r AS (SELECT rec, CAST(trunc((max(frame) / 10 - 1.3::DOUBLE) * 10) AS BIGINT) AS hi FROM frames GROUP BY rec) SELECT rec, frame - 7 AS frame, round(x, 6) AS x FROM frames JOIN r USING (rec) WHERE frame >= 7 AND frame < hi",
    "replace_range": f"""{_F}, n AS (SELECT rec, count(*) AS n, least(16, count(*)) AS m, least(5, count(*)) AS lo, least(21, count(*)) AS hi, rec % 3 = 0 AND count(*) > 5 AS put FROM frames GROUP BY rec)
SELECT rec, CASE WHEN NOT put OR frame < lo THEN frame ELSE frame - hi + lo + m END AS frame, round(x, 6) AS x FROM frames JOIN n USING (rec) WHERE NOT put OR frame < lo OR frame >= hi
UNION ALL SELECT rec, frame + lo, round(-x, 6) FROM frames JOIN n USING (rec) WHERE put AND frame < 16""",
    "subtract_signals": f"{_F} SELECT rec, frame, round(x - 0.5::DOUBLE * x, 6) AS x FROM frames",
    "mix_signals": f"""{_F}, a AS (SELECT rec, frame + 7 AS frame, x FROM frames UNION ALL SELECT rec, frame, 0.5::DOUBLE * x FROM frames)
SELECT rec, frame, round(sum(x), 6) AS x FROM a GROUP BY rec, frame""",
    "append_signals": f"{_F}, n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec) SELECT rec, frame, round(x, 6) AS x FROM frames UNION ALL SELECT rec, frame + n, round(0.5::DOUBLE * x, 6) FROM frames JOIN n USING (rec)",
    "pcm16": f"{_F}, {_BLOCK}, p AS (SELECT rec, k, CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x * 3)) * 32767) AS INTEGER) AS v FROM b) SELECT rec, k AS block_idx, max(v) AS top, CAST(sum(v) AS BIGINT) AS total FROM p GROUP BY ALL",
    "normalize_peak": f"{_F} SELECT rec, round(sqrt(avg(x * x)) * pow(10, -0.15) / max(abs(x)), 6) AS rms, round(pow(10, -0.15), 6) AS peak FROM frames GROUP BY rec",
    "normalize_rms": f"{_F}, l AS (SELECT rec, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM frames GROUP BY rec), g AS (SELECT *, least(pow(10, -0.3) / rms, 0.99::DOUBLE / peak) AS gain FROM l) SELECT rec, round(rms * gain, 6) AS rms, round(peak * gain, 6) AS peak FROM g",
    "snr": f"{_F} SELECT rec, round(10 * log10(sum(x * x) / sum((x - 0.5::DOUBLE * x) * (x - 0.5::DOUBLE * x))), 6) AS db FROM frames GROUP BY rec",
    "signal_correlation": f"{_F}, {_BLOCK}, y AS (SELECT a.rec, a.x, (SELECT 1) AS o, a.frame, a.k, max(a.frame) OVER (PARTITION BY rec, k) + min(a.frame) OVER (PARTITION BY rec, k) - a.frame AS m FROM b a) SELECT y.rec, round(sum(y.x * f.x) / sqrt(sum(y.x * y.x) * sum(f.x * f.x)), 6) AS value FROM y JOIN frames f ON y.rec = f.rec AND y.m = f.frame GROUP BY y.rec",
    "tone_energy": f"{_F} SELECT rec, round(2 * sqrt(pow(sum(x * cos(frame * 2 * pi() * 3 / 40)), 2) + pow(sum(x * sin(frame * 2 * pi() * 3 / 40)), 2)) / count(*), 6) AS energy FROM frames GROUP BY rec",
    "mono": f"{_F} SELECT rec, frame, round((x + 3 * x) / 2, 6) AS x FROM frames",
    "signal_qa": f"""{_F}, {_BLOCK}, o AS (SELECT rec, frame, x AS given, rec % 4 <> 1 OR k = 0 AS there, rec % 5 = 0 AND frame % 16 = 3 AS bad, CASE rec % 4 WHEN 2 THEN x * 0.001::DOUBLE WHEN 3 THEN x * 0.9::DOUBLE ELSE x END AS y FROM b),
s AS (SELECT rec, count(*) AS m, count(*) FILTER (there) AS n, count(*) FILTER (there AND bad) AS bad, max(abs(y)) FILTER (there) AS peak, count(*) FILTER (there AND abs(given - y) < 1e-4) AS same FROM o GROUP BY rec)
SELECT rec, CASE WHEN bad > 0 THEN 'non-finite' ELSE array_to_string(list_filter([CASE WHEN abs(n - m) > 2 THEN 'length' END, CASE WHEN peak < 0.01 THEN 'silent' END, CASE WHEN same > 0.99 * n THEN 'unchanged' END], lambda p: p IS NOT NULL), ',') END AS problems FROM s""",
    "fit_length": f"{_F}, {_BLOCK}, n AS (SELECT *, frame % 16 AS i, count(*) OVER (PARTITION BY rec, k) AS n FROM b) SELECT rec, k AS block_idx, round(sum(x * (20 // n + CASE WHEN i < 20 % n THEN 1 ELSE 0 END)), 6) AS cycle, round(coalesce(sum(x) FILTER (i < 12), 0), 6) AS zero FROM n GROUP BY rec, k",
    "chunk_plan": f"{_F}, {_PLAN} SELECT rec, CAST(start_frame // 15 AS INTEGER) AS chunk_idx, start_frame, least(20, total) AS n_frames, start_frame = 0 AS is_first, start_frame = max(start_frame) OVER (PARTITION BY rec) AS is_last FROM plan",
    "chunk_plan_discard": f"{_F}, {_PLAN.replace('range(0, total, 15)', 'range(0, greatest(0, total - 5) + 1, 15)')} SELECT rec, CAST(start_frame // 15 AS INTEGER) AS chunk_idx, start_frame, least(20, total) AS n_frames, start_frame = 0 AS is_first, start_frame = max(start_frame) OVER (PARTITION BY rec) AS is_last FROM plan",
    "make_chunks": f"{_F}, {_PLAN} SELECT p.rec, CAST(start_frame // 15 AS BIGINT) AS chunk_idx, round(sum(x), 6) AS total, CAST(least(20, max(total)) AS INTEGER) AS n FROM plan p JOIN frames f ON p.rec = f.rec AND frame >= start_frame AND frame < start_frame + 20 GROUP BY p.rec, start_frame",
    **{f"stitch_{b}": _SAME for b in ("none", "triangular", "hann")},
    "stitch_discard": DISCARD,
    "stitch_discard_tail": DISCARD_TAIL,
    "stitch_hann_plain": _SAME.replace("round(x, 6) AS x FROM frames", "CASE WHEN total > 1 AND (frame = 0 OR frame = total - 1 AND total <= 20) THEN 0.0::DOUBLE ELSE round(x, 6) END AS x FROM frames JOIN (SELECT rec, count(*) AS total FROM frames GROUP BY rec) USING (rec)"),
    "stitch_blend": f"""{_F}, {_PLAN}, w AS (SELECT p.rec, frame, start_frame // 15 AS c, CASE WHEN frame - start_frame < least(20, total) // 2 THEN (frame - start_frame + 1) / greatest(least(20, total) // 2, 1)::DOUBLE ELSE (least(20, total) - (frame - start_frame)) / greatest(least(20, total) // 2, 1)::DOUBLE END AS w
  FROM plan p JOIN frames f ON p.rec = f.rec AND frame >= start_frame AND frame < start_frame + 20) SELECT rec, frame, round(sum(w * c) / sum(w), 6) AS x FROM w GROUP BY rec, frame""",
    "resample_linear": f"{_F} SELECT rec, 2 * frame AS frame, round(x, 6) AS x FROM frames UNION ALL SELECT rec, 2 * frame + 1, round((x + coalesce(lead(x) OVER (PARTITION BY rec ORDER BY frame), x)) / 2, 6) FROM frames",
    "best_lag": f"{_F}, l AS (SELECT a.rec, lag, sum(a.x * b.x) AS s FROM (SELECT unnest(range(-8, 9)) AS lag), frames a JOIN frames b ON a.rec = b.rec AND b.frame = a.frame + lag - 3 GROUP BY ALL) SELECT rec, CAST(arg_min(lag, (-s, lag)) AS INTEGER) AS lag FROM l GROUP BY rec",
    "bandwidth": f"""{_F}, n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec HAVING count(*) >= 16), fr AS (SELECT rec, unnest(range((n - 16) // 8 + 1)) AS f FROM n),
y AS (SELECT fr.rec, f, k, sum(x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (frame - 8 * f) / 15)) * cos(2 * pi() * k * (frame - 8 * f) / 16)) AS re, sum(x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (frame - 8 * f) / 15)) * sin(2 * pi() * k * (frame - 8 * f) / 16)) AS im
  FROM fr JOIN frames ON fr.rec = frames.rec AND frame >= 8 * f AND frame < 8 * f + 16, (SELECT unnest(range(9)) AS k) GROUP BY ALL),
e AS (SELECT rec, k, sum(re * re + im * im) AS e FROM y GROUP BY ALL), c AS (SELECT rec, k, sum(e) OVER (PARTITION BY rec ORDER BY k) AS run, sum(e) OVER (PARTITION BY rec) AS total FROM e)
SELECT rec, round(min(k) * 1000.0::DOUBLE, 3) AS f_high, min(k) * 1000 >= 7600 AS passthrough FROM c WHERE run >= 0.99::DOUBLE * total GROUP BY rec""",
    "trim_silence": f"{_F}, {TRIM} SELECT rec, lo, hi FROM cuts",
}
