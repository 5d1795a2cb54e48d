"""Queries over spectra, channels, resampling, presets, segments and the model surface."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as c
from ..operators import embeddings as e
from ..operators import models as m
from ..operators import signals as g
from ..operators import spectral as sp
from ..sources import views as v
from .audio import stereo
from .pipeline import Pipeline, stage_metrics
from .signals import CONFIG, TRIM, flat


def _bins(features: DataFrame, digits: int = 5) -> DataFrame:
    return features.select("rec", "frame", F.posexplode("bins").alias("bin", "x")).withColumn("x", F.round("x", digits))


def _three(s: SparkSession, d: str) -> DataFrame:
    """Recordings of one, two or three channels."""
    x = v.blocks(s, d).withColumn("channel", F.explode(F.sequence(F.lit(0), (F.col("rec") % 3).cast("int"))))
    return g.scale(x, F.col("channel") + 1.0)


def _needs(s, d):
    return v.frames(s, d).select(F.concat(F.lit("r"), F.col("rec").cast("string")).alias("rec"), F.when(F.col("rec") % 2 == 0, 32000).otherwise(16000).alias("rate"), (F.col("rec") % 3 % 2 + 1).cast("int").alias("channels")).distinct()


def _chunks(s, d):
    return c.make_chunks(v.blocks(s, d), CONFIG)


def _double(xs: list[np.ndarray]) -> list[np.ndarray]:
    return [x * 2 for x in xs]


def _split(xs: list[np.ndarray]) -> list[list[np.ndarray]]:
    return [[x, x * -3] for x in xs]


def _peaks(xs: list[np.ndarray]) -> list[list[dict]]:
    return [[{"at": int(np.argmax(x)), "n": len(x)}] for x in xs]


def _pipeline(s, d):
    """Speech is found, louder speech is separated per track, and both tracks are put together again."""
    p = (
        Pipeline().enhance(lambda x: m.apply_model(x, _double)).analyze(lambda x: m.analyze(x, _peaks, "at int, n int")).conditionally("signals", F.col("rec") % 2 == 0, lambda x: g.scale(x, 0.5))
        .detect(lambda x: g.levels(x).where("rms > 0").select("rec")).separate_per_target(lambda x, t: m.fan_out(x, t, lambda y, w: y * w[0])).for_each(lambda x: g.scale(x, 10.0)).upscale(lambda x: g.resample(x, 10, 20, "fast", 32))
    )
    targets = s.createDataFrame([("a", [1.0]), ("b", [-1.0])], "target string, weights array<double>")
    t = p.run(signals=v.blocks(s, d), targets=targets)
    tracks = t["tracks"].groupBy("rec", "target").agg(F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))
    return tracks.join(t["analysis"].groupBy("rec").agg(F.sum("n").alias("analyzed")), "rec").join(g.lengths(t["signals"]), "rec").join(t["vad"], "rec", "left_semi")


def _mels(s, d):
    return v.frames(s, d).groupBy(F.col("rec").alias("utt")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x", "prob"))), lambda t: F.array(t["x"], t["prob"])).alias("mels"))


def _window_mean(windows: list[np.ndarray]) -> np.ndarray:
    return np.array([w.mean(axis=0) for w in windows])


def _stages(s, d):
    """Starts and ends of stages, of which some are in branches."""
    x = v.events(s, d)
    return x.select(F.col("rec").cast("string").alias("run"), F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 3).cast("int")).alias("branch"), F.col("event_type").alias("stage"), (F.col("start_ms") / 1000).alias("at"))


QUERIES = {
    "stft": lambda s, d: _bins(sp.stft(v.blocks(s, d), 8, 4, size=32)),
    "istft": lambda s, d: flat(sp.istft(sp.stft(v.blocks(s, d), 8, 4, size=32), g.lengths(v.blocks(s, d)), 8, 4, block=4)),
    "stft_short_window": lambda s, d: _bins(sp.stft(v.blocks(s, d), 8, 4, size=32, center=False, win_length=6), 8),
    "istft_window_sum": lambda s, d: _window_sum(s, d),
    "fbank_mirrored": lambda s, d: _bins(sp.kaldi_fbank(v.blocks(s, d), 640, 4, snip_edges=False)),
    "mel": lambda s, d: _bins(sp.mel(v.blocks(s, d), 16, 8, 4, 3, "htk")),
    "log_mel": lambda s, d: _bins(sp.log_mel(v.blocks(s, d), 16000, 8)),
    "kaldi_fbank": lambda s, d: _bins(sp.kaldi_fbank(v.blocks(s, d), 640, 4)),
    "deltas": lambda s, d: _bins(sp.with_deltas(v.frames(s, d).select("rec", "frame", F.array("x", "prob").alias("bins")), 2, 16), 8),
    "convert_channels": lambda s, d: flat(g.convert_channels(_three(s, d), 2)),
    "stereo_pairs": lambda s, d: g.stereo_pair(_three(s, d)).groupBy("rec", "channel").agg(F.sum(F.size("samples")).alias("n")),
    "interleave": lambda s, d: g.interleave(_three(s, d)).select("rec", "block_idx", "channels", F.array_join(F.transform("samples", lambda x: F.round(x * 500, 2).cast("decimal(20,2)").cast("string")), ",").alias("samples")),
    "deinterleave": lambda s, d: flat(g.deinterleave(g.interleave(_three(s, d)))),
    "resample_cubic": lambda s, d: flat(g.resample(v.blocks(s, d), 10, 20, "balanced", 32), 8),
    "resample_high": lambda s, d: flat(g.resample(v.blocks(s, d), 20, 10, "high", 32)),
    "resample_channels": lambda s, d: flat(g.resample(g.blocks_of(stereo(s, d)), 16000, 32000, "fast", 24)),
    "adapt": lambda s, d: flat(m.adapt(stereo(s, d).withColumn("samples", F.col("samples").cast("array<double>")), _needs(s, d), "fast")),
    "normalize_floor": lambda s, d: g.levels(g.normalize(v.blocks(s, d), "floor", 0.3)).select("rec", F.round("rms", 6).alias("rms")),
    "match_mixture": lambda s, d: g.levels(g.match_mixture(g.scale(v.blocks(s, d).withColumn("output_idx", F.explode(F.array(F.lit(1), F.lit(2)))), F.col("output_idx") * 0.25), g.scale(v.blocks(s, d), F.when(F.col("rec") % 2 == 0, 4.0).otherwise(1.0)))).select("rec", "output_idx", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak")),
    "chunk_presets": lambda s, d: _presets(s, d),
    "stitch_multi": lambda s, d: flat(c.stitch_multi(m.separate(_chunks(s, d), _split, 2), CONFIG)),
    "segments": lambda s, d: c.segment(v.blocks(s, d), 2.0, 8).select("rec", "chunk_idx", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total")),
    "segments_back": lambda s, d: flat(c.reassemble(c.segment(v.blocks(s, d), 2.0, 8))),
    "trimmed_silence": lambda s, d: flat(g.trimmed(v.blocks(s, d), 20, frame=8, hop=4, size=32)),
    "apply_model": lambda s, d: flat(c.stitch(m.apply_model(_chunks(s, d), make=lambda: _double), CONFIG)),
    "apply_model_barrier": lambda s, d: flat(c.stitch(m.apply_model(_chunks(s, d), _double, barrier=True), CONFIG)),
    "separate_sql": lambda s, d: _separate_sql(s, d),
    "separate": lambda s, d: m.separate(_chunks(s, d), _split, 2).groupBy("rec", "output_idx").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)), 6).alias("total")),
    "analyze": lambda s, d: m.analyze(v.blocks(s, d).select("rec", "block_idx", "samples"), _peaks, "at int, n int", ("rec", "block_idx")),
    "embed_segments": lambda s, d: m.embed(v.blocks(s, d), lambda xs: [[x.sum(), x.max()] for x in xs]).select("rec", "block_idx", F.round(F.col("embedding")[0], 6).alias("a"), F.round(F.col("embedding")[1], 6).alias("b")),
    "map_text": lambda s, d: m.map_text(v.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), lambda ts: [t and t[::-1] for t in ts]),
    "pipeline_stages": _pipeline,
    "routed_recordings": lambda s, d: Pipeline().conditionally("signals", F.col("n") > 66, lambda x: x.withColumn("way", F.lit("then")), lambda x: x.withColumn("way", F.lit("else"))).run(signals=g.lengths(v.blocks(s, d)))["signals"],
    "parallel_branches": lambda s, d: Pipeline().parallel("signals", [lambda x: x.where("n % 2 = 0").select("rec", (F.col("n") * 10).alias("n")), lambda x: x.where("n % 3 = 0").select("rec", (F.col("n") * 100).alias("n"))]).run(signals=g.lengths(v.blocks(s, d)))["signals"],
    "for_each_track": lambda s, d: g.levels(Pipeline().for_each(lambda x: g.normalize(x, "peak", 0.0)).run(tracks=m.separate(v.blocks(s, d), _split, 2))["tracks"]).select("rec", "output_idx", F.round("peak", 6).alias("peak")),
    "fan_out": lambda s, d: m.fan_out(v.blocks(s, d), v.table(s, d, "nation").select(F.col("n_name").alias("target"), F.array(F.col("n_nationkey").cast("double")).alias("weights")), lambda x, w: x * w[0]).groupBy("rec", "target").agg(F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)), 5).alias("total")),
    "stage_metrics": lambda s, d: stage_metrics(_stages(s, d)).withColumn("duration", F.round("duration", 3)),
    "utterance_embeddings": lambda s, d: e.utterance_embeddings(_mels(s, d), _window_mean, 8, 0.5).select("utt", F.round(F.col("embedding")[0], 6).alias("a"), F.round(F.col("embedding")[1], 6).alias("b")),
    "valid_targets": lambda s, d: e.valid_targets(v.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") % 5 == 0) & (i == 3), float("nan")).otherwise(x.cast("double"))).alias("weights")).withColumn("weights", F.when(F.col("vec_id") % 7 == 0, F.slice("weights", 1, 3)).otherwise(F.col("weights"))), 64).select("vec_id", "error"),
}


def _window_sum(s, d):
    x = sp.stft(v.blocks(s, d), 8, 4, size=32)
    return flat(sp.istft(x, sp.n_frames(x, 8, 4), 8, 4, block=4, norm="sum"))


class _Levelled:
    """A separator that follows a recording: the second output is less the largest sample it has met so far."""

    def __init__(self):
        self.most = 0.0

    def __call__(self, xs: list[np.ndarray]) -> list[list[np.ndarray]]:
        out = []
        for x in xs:
            self.most = max(self.most, float(x.max()))
            out.append([x, x - self.most])
        return out


def _separate_sql(s, d):
    x = _chunks(s, d)
    m.register_separator(x, "separate_levelled", _Levelled, 2)
    return s.sql("SELECT rec, chunk_idx, output_idx, round(aggregate(samples, 0D, (a, y) -> a + y), 6) AS total FROM separate_levelled(TABLE({x}) PARTITION BY rec ORDER BY chunk_idx)", x=x)


def _presets(s, d):
    totals = v.frames(s, d).groupBy("rec").agg((F.count("*") * 10_000).alias("total"))
    out = None
    for name in c.PRESETS:
        config = c.preset(name)
        x = c.covered_share(c.chunk_plan(totals, config, config.blend == "discard")).select("rec", F.lit(name).alias("preset"), "chunks", "last_start")
        out = x if out is None else out.unionByName(x)
    return out


_F = v.using("frames")
_N = "n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec)"


def _power(n_fft: int, hop: int, window: str, reflect: bool) -> str:
    """Spectra by frame and bin: re, im of centred windows."""
    half = n_fft // 2
    q = f"CASE WHEN p < 0 THEN -p WHEN p >= n THEN 2 * (n - 1) - p ELSE p END" if reflect else "p"  # noqa: F541
    return f"""{_N}, fr AS (SELECT rec, n, unnest(range(n // {hop} + 1)) AS f FROM n), w AS (SELECT j, {window} AS w FROM (SELECT unnest(range({n_fft})) AS j)),
y AS (SELECT rec, f, j, w, {q} AS q FROM (SELECT rec, n, f, j, w, f * {hop} - {half} + j AS p FROM fr, w)), z AS (SELECT y.rec, f, j, x * w AS x FROM y JOIN frames ON y.rec = frames.rec AND q = frame),
spec AS (SELECT rec, f AS frame, k, sum(x * cos(2 * pi() * k * j / {n_fft})) AS re, -sum(x * sin(2 * pi() * k * j / {n_fft})) AS im FROM z, (SELECT unnest(range({half + 1})) AS k) GROUP BY ALL)"""


def _filters(rate: int, n_fft: int, n_mels: int, low: float, scale: str) -> str:
    """Triangles on the mel scale, from their definition."""
    if scale == "htk":
        to, back, norm = "2595 * log10(1 + {} / 700.0::DOUBLE)", "700 * (pow(10, {} / 2595.0::DOUBLE) - 1)", "1"
    else:
        to = "CASE WHEN {0} < 1000 THEN {0} * 3 / 200.0::DOUBLE ELSE 15 + ln({0} / 1000.0::DOUBLE) / (ln(6.4::DOUBLE) / 27) END"
        back, norm = "CASE WHEN {0} < 15 THEN {0} * 200 / 3.0::DOUBLE ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * ({0} - 15)) END", "2 / (h2 - h0)"
    lo, hi = to.format(f"{low}::DOUBLE"), to.format(f"{rate / 2}::DOUBLE")
    m = f"(({lo}) + (i * (({hi}) - ({lo})) / {n_mels + 1}))"
    return f"""hz AS (SELECT i, {back.format(m)} AS h FROM (SELECT unnest(range({n_mels + 2})) AS i)), tri AS (SELECT a.i AS bin, a.h AS h0, b.h AS h1, c.h AS h2 FROM hz a JOIN hz b ON b.i = a.i + 1 JOIN hz c ON c.i = a.i + 2),
filt AS (SELECT bin, k, greatest(0, least((k * {rate} / {n_fft}.0::DOUBLE - h0) / (h1 - h0), (h2 - k * {rate} / {n_fft}.0::DOUBLE) / (h2 - h1))) * {norm} AS w FROM tri, (SELECT unnest(range({n_fft // 2 + 1})) AS k))"""


_HANN = "0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / {}.0::DOUBLE)"
_THREE = f"{_F}, ch AS (SELECT rec, frame, channel, x * (channel + 1) AS x FROM (SELECT rec, frame, x, unnest(range(rec % 3 + 1)) AS channel FROM frames))"
_CUBIC = "p1 + 0.25::DOUBLE * (p2 - p0 + 0.5::DOUBLE * (2 * p0 - 5 * p1 + 4 * p2 - p3 + 0.5::DOUBLE * (3 * (p1 - p2) + p3 - p0)))"


def _slope(x: str) -> str:
    at = lambda k: f"coalesce({'lead' if k > 0 else 'lag'}({x}, {abs(k)}) OVER o, {'last' if k > 0 else 'first'}_value({x}) OVER (PARTITION BY rec ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return f"((({at(1)}) - ({at(-1)})) + 2 * (({at(2)}) - ({at(-2)}))) / 10"


def _deltas() -> str:
    one = ", ".join(f"{_slope(k)} AS d{k}" for k in ("x", "prob"))
    two = ", ".join(f"{_slope('d' + k)} AS e{k}" for k in ("x", "prob"))
    w = "WINDOW o AS (PARTITION BY rec ORDER BY frame)"
    cols = ", ".join(["x", "prob", "dx", "dprob", "ex", "eprob"])
    return f"{_F}, a AS (SELECT *, {one} FROM frames {w}), b AS (SELECT *, {two} FROM a {w}) SELECT rec, frame, CAST(i - 1 AS INTEGER) AS bin, round(v[i], 8) AS x FROM (SELECT rec, frame, [{cols}] AS v, unnest(range(1, 7)) AS i FROM b)"


_PRESETS = " UNION ALL ".join(
    f"SELECT rec, '{k}' AS preset, total, {c.preset(k).chunk} AS chunk, {c.preset(k).stride} AS stride, {str(c.preset(k).blend == 'discard').lower()} AS discard FROM t" for k in c.PRESETS
)
_PLAN = "tot AS (SELECT rec, count(*) AS total FROM frames GROUP BY rec), plan AS (SELECT rec, total, unnest(CASE WHEN total <= 20 THEN [0] ELSE range(0, total, 15) END) AS start_frame FROM tot)"
SQL = {
    "stft": f"{_F}, {_power(8, 4, _HANN.format(8), True)} SELECT rec, frame, CAST(k AS INTEGER) AS bin, round(re, 5) AS x FROM spec UNION ALL SELECT rec, frame, CAST(k + 5 AS INTEGER), round(im, 5) FROM spec",
    "istft": f"{_F} SELECT rec, frame, round(x, 6) AS x FROM frames",
    "stft_short_window": f"""{_F}, {_N}, fr AS (SELECT rec, unnest(range((n - 8) // 4 + 1)) AS f FROM n WHERE n >= 8), z AS (SELECT fr.rec, f, frame - 4 * f AS j, CASE WHEN frame - 4 * f < 6 THEN x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (frame - 4 * f) / 6.0::DOUBLE)) ELSE 0 END AS x FROM fr JOIN frames ON fr.rec = frames.rec AND frame >= 4 * f AND frame < 4 * f + 8),
spec AS (SELECT rec, f AS frame, k, sum(x * cos(2 * pi() * k * j / 8)) AS re, -sum(x * sin(2 * pi() * k * j / 8)) AS im FROM z, (SELECT unnest(range(5)) AS k) GROUP BY ALL)
SELECT rec, frame, CAST(k AS INTEGER) AS bin, round(re, 8) AS x FROM spec UNION ALL SELECT rec, frame, CAST(k + 5 AS INTEGER), round(im, 8) FROM spec""",
    # Windowed frames, windowed again by one of nine samples that has lost its last, over the sum of these.
    "istft_window_sum": f"""{_F}, {_power(8, 4, _HANN.format(8), True)}, o AS (SELECT rec, 4 * f - 4 + j AS frame, sum(x * v) AS x, sum(v) AS v FROM (SELECT *, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 9.0::DOUBLE) AS v FROM z) GROUP BY ALL)
SELECT o.rec, frame, round(CASE WHEN v <> 0 THEN x / v ELSE x END, 6) AS x FROM o JOIN n USING (rec) WHERE frame >= 0 AND frame < n // 4 * 4""",
    "fbank_mirrored": f"""{_F}, {_N}, fr AS (SELECT rec, n, unnest(range((n + 3) // 6)) AS f FROM n), p AS (SELECT rec, n, f, j, 6 * f - 5 + j AS p FROM fr, (SELECT unnest(range(16)) AS j)),
q AS (SELECT p.rec, f, j, coalesce(x, 0) AS x FROM p LEFT JOIN frames ON p.rec = frames.rec AND frame = CASE WHEN n <= 5 THEN p WHEN p < 0 THEN -p WHEN p >= n THEN 2 * (n - 1) - p ELSE p END),
y AS (SELECT rec, f, j, x - avg(x) OVER (PARTITION BY rec, f) AS x FROM q),
z AS (SELECT rec, f, j, (x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY rec, f ORDER BY j), x)) * pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 15.0::DOUBLE), 0.85::DOUBLE) AS x FROM y),
spec AS (SELECT rec, f AS frame, k, sum(x * cos(2 * pi() * k * j / 16)) AS re, sum(x * sin(2 * pi() * k * j / 16)) AS im FROM z, (SELECT unnest(range(9)) AS k) GROUP BY ALL), {_filters(640, 16, 4, 20.0, 'htk')}
SELECT rec, frame, CAST(bin AS INTEGER) AS bin, round(ln(greatest(sum((re * re + im * im) * w), 1.1920929e-07)), 5) AS x FROM spec JOIN filt USING (k) GROUP BY ALL""",
    "mel": f"{_F}, {_power(8, 4, _HANN.format(8), True)}, {_filters(16, 8, 3, 0.0, 'htk')} SELECT rec, frame, CAST(bin AS INTEGER) AS bin, round(sum((re * re + im * im) * w), 5) AS x FROM spec JOIN filt USING (k) GROUP BY ALL",
    "log_mel": f"{_F}, {_power(400, 160, _HANN.format(400), False)}, {_filters(16000, 400, 8, 0.0, 'slaney')}, l AS (SELECT rec, frame, bin, log10(greatest(sum((re * re + im * im) * w), 1e-10)) AS v FROM spec JOIN filt USING (k) GROUP BY ALL) SELECT rec, frame, CAST(bin AS INTEGER) AS bin, round((greatest(v, max(v) OVER (PARTITION BY rec) - 8) + 4) / 4, 5) AS x FROM l",
    "kaldi_fbank": f"""{_F}, {_N}, fr AS (SELECT rec, unnest(range((n - 16) // 6 + 1)) AS f FROM n WHERE n >= 16), y AS (SELECT fr.rec, f, frame - 6 * f AS j, x - avg(x) OVER (PARTITION BY fr.rec, f) AS x FROM fr JOIN frames ON fr.rec = frames.rec AND frame >= 6 * f AND frame < 6 * f + 16),
z AS (SELECT rec, f, j, (x - 0.97::DOUBLE * coalesce(lag(x) OVER (PARTITION BY rec, f ORDER BY j), x)) * pow(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 15.0::DOUBLE), 0.85::DOUBLE) AS x FROM y),
spec AS (SELECT rec, f AS frame, k, sum(x * cos(2 * pi() * k * j / 16)) AS re, sum(x * sin(2 * pi() * k * j / 16)) AS im FROM z, (SELECT unnest(range(9)) AS k) GROUP BY ALL), {_filters(640, 16, 4, 20.0, 'htk')}
SELECT rec, frame, CAST(bin AS INTEGER) AS bin, round(ln(greatest(sum((re * re + im * im) * w), 1.1920929e-07)), 5) AS x FROM spec JOIN filt USING (k) GROUP BY ALL""",
    "deltas": _deltas(),
    "convert_channels": f"{_THREE} SELECT rec, channel, frame, round(x, 6) AS x FROM ch WHERE rec % 3 = 1 UNION ALL SELECT rec, c, frame, round(avg(x), 6) FROM ch, (SELECT unnest([0, 1]) AS c) WHERE rec % 3 <> 1 GROUP BY ALL",
    "stereo_pairs": f"{_F} SELECT rec, c AS channel, count(*) AS n FROM frames, (SELECT unnest([0, 1]) AS c) GROUP BY ALL",
    "interleave": f"{_THREE} SELECT rec, frame // 16 AS block_idx, CAST(rec % 3 + 1 AS INTEGER) AS channels, string_agg(printf('%.2f', round(x * 500, 2)), ',' ORDER BY frame, channel) AS samples FROM ch GROUP BY ALL",
    "deinterleave": f"{_THREE} SELECT rec, CAST(channel AS INTEGER) AS channel, frame, round(x, 6) AS x FROM ch",
    "resample_cubic": f"{_F}, k AS (SELECT rec, frame, x AS p1, coalesce(lag(x) OVER o, x) AS p0, coalesce(lead(x) OVER o, x) AS p2, coalesce(lead(x, 2) OVER o, lead(x) OVER o, x) AS p3 FROM frames WINDOW o AS (PARTITION BY rec ORDER BY frame)) SELECT rec, 2 * frame AS frame, round(p1, 8) AS x FROM k UNION ALL SELECT rec, 2 * frame + 1, round({_CUBIC}, 8) FROM k",
    "resample_high": f"""{_F}, {_N}, o AS (SELECT rec, n, unnest(range(n // 2)) AS f FROM n), k AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * 0.475::DOUBLE * k) / (pi() * 0.475::DOUBLE * k) END * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * k / 65.0::DOUBLE)) AS w FROM (SELECT unnest(range(-64, 65)) AS k))
SELECT o.rec, f AS frame, round(sum(w * x) / sum(w), 6) AS x FROM o, k, frames WHERE frames.rec = o.rec AND frame = least(greatest(2 * f + k, 0), n - 1) GROUP BY ALL""",
    "resample_channels": f"{_F}, y AS (SELECT rec, frame, channel, CAST(CAST(x * CASE channel WHEN 0 THEN 1 ELSE -0.5::DOUBLE END AS FLOAT) AS DOUBLE) AS x FROM frames, (SELECT unnest([0, 1]) AS channel)) SELECT 'r' || rec AS rec, channel, 2 * frame AS frame, round(x, 6) AS x FROM y UNION ALL SELECT 'r' || rec, channel, 2 * frame + 1, round((x + coalesce(lead(x) OVER (PARTITION BY rec, channel ORDER BY frame), x)) / 2, 6) FROM y",
    "adapt": f"""{_F}, y AS (SELECT rec, frame, channel, CAST(CAST(x * CASE channel WHEN 0 THEN 1 ELSE -0.5::DOUBLE END AS FLOAT) AS DOUBLE) AS x FROM frames, (SELECT unnest([0, 1]) AS channel)), z AS (SELECT rec, frame, channel, x FROM y WHERE rec % 3 % 2 = 1 UNION ALL SELECT rec, frame, 0, avg(x) FROM y WHERE rec % 3 % 2 = 0 GROUP BY rec, frame)
SELECT 'r' || rec AS rec, channel, CASE WHEN rec % 2 = 0 THEN 2 * frame ELSE frame END AS frame, round(x, 6) AS x FROM z UNION ALL SELECT 'r' || rec, channel, 2 * frame + 1, round(y, 6) FROM (SELECT *, (x + coalesce(lead(x) OVER (PARTITION BY rec, channel ORDER BY frame), x)) / 2 AS y FROM z) WHERE rec % 2 = 0""",
    "normalize_floor": f"{_F} SELECT rec, round(greatest(sqrt(avg(x * x)), 0.3::DOUBLE), 6) AS rms FROM frames GROUP BY rec",
    "match_mixture": f"{_F}, l AS (SELECT rec, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM frames GROUP BY rec), h AS (SELECT *, CASE WHEN rec % 2 = 0 THEN 4 ELSE 1 END AS up FROM l) SELECT rec, CAST(o AS INTEGER) AS output_idx, round(rms * up / greatest(1, peak * up), 6) AS rms, round(peak * up / greatest(1, peak * up), 6) AS peak FROM h, (SELECT unnest([1, 2]) AS o)",
    "chunk_presets": f"{_F}, t AS (SELECT rec, count(*) * 10000 AS total FROM frames GROUP BY rec), p AS ({_PRESETS}), n AS (SELECT *, CASE WHEN total <= chunk THEN 1 WHEN discard THEN (total + stride - chunk) // stride + 1 ELSE (total - 1) // stride + 1 END AS chunks FROM p) SELECT rec, preset, chunks, (chunks - 1) * stride AS last_start FROM n",
    "stitch_multi": f"{_F} SELECT rec, o AS output_idx, frame, round(CASE o WHEN 0 THEN x ELSE -3 * x END, 6) AS x FROM frames, (SELECT unnest([0, 1]) AS o)",
    "segments": f"{_F} SELECT rec, frame // 16 AS chunk_idx, 16 AS n, round(sum(x), 6) AS total FROM frames GROUP BY ALL",
    "segments_back": f"{_F} SELECT rec, frame, round(x, 6) AS x FROM frames",
    "trimmed_silence": f"{_F}, {TRIM} SELECT rec, frame - lo AS frame, round(x, 6) AS x FROM frames JOIN cuts USING (rec) WHERE frame >= lo AND frame < hi",
    "apply_model": f"{_F} SELECT rec, frame, round(2 * x, 6) AS x FROM frames",
    "apply_model_barrier": f"{_F} SELECT rec, frame, round(2 * x, 6) AS x FROM frames",
    "separate_sql": f"""{_F}, {_PLAN}, k AS (SELECT p.rec, start_frame // 15 AS chunk_idx, total, start_frame, sum(x) AS t, max(x) AS most FROM plan p JOIN frames f ON p.rec = f.rec AND frame >= start_frame AND frame < start_frame + 20 GROUP BY ALL),
m AS (SELECT *, max(CASE WHEN total > 20 AND start_frame + 20 > total THEN greatest(most, 0) ELSE most END) OVER (PARTITION BY rec ORDER BY chunk_idx) AS met FROM k)
SELECT rec, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(o AS INTEGER) AS output_idx, round(CASE o WHEN 0 THEN t ELSE t - greatest(met, 0) * CASE WHEN total <= 20 THEN total ELSE 20 END END, 6) AS total FROM m, (SELECT unnest([0, 1]) AS o)""",
    "separate": f"{_F}, {_PLAN} SELECT p.rec, o AS output_idx, count(DISTINCT start_frame) AS n, round(sum(CASE o WHEN 0 THEN x ELSE -3 * x END), 6) AS total FROM plan p JOIN frames f ON p.rec = f.rec AND frame >= start_frame AND frame < start_frame + 20, (SELECT unnest([0, 1]) AS o) GROUP BY ALL",
    "analyze": f"{_F} SELECT rec, frame // 16 AS block_idx, CAST(arg_min(frame, (-x, frame)) % 16 AS INTEGER) AS at, CAST(count(*) AS INTEGER) AS n FROM frames GROUP BY ALL",
    "embed_segments": f"{_F} SELECT rec, frame // 16 AS block_idx, round(sum(x), 6) AS a, round(max(x), 6) AS b FROM frames GROUP BY ALL",
    "map_text": "SELECT conv_id * 1000 + turn AS id, reverse(text) AS text FROM conversations",
    "pipeline_stages": f"{_F}, {_N}, y AS (SELECT rec, frame, x * CASE WHEN rec % 2 = 0 THEN 1 ELSE 2 END AS x, lead(x) OVER (PARTITION BY rec ORDER BY frame) * CASE WHEN rec % 2 = 0 THEN 1 ELSE 2 END AS nx FROM frames) SELECT y.rec, target, round(sum(CASE target WHEN 'a' THEN 10 ELSE -10 END * (x + (x + coalesce(nx, x)) / 2)), 6) AS total, max(n) AS analyzed, max(n) AS n FROM y JOIN n ON y.rec = n.rec, (SELECT unnest(['a', 'b']) AS target) GROUP BY y.rec, target",
    "routed_recordings": f"{_F} SELECT rec, count(*) AS n, CASE WHEN count(*) > 66 THEN 'then' ELSE 'else' END AS way FROM frames GROUP BY rec",
    "parallel_branches": f"{_F}, {_N} SELECT rec, CASE WHEN n % 3 = 0 THEN n * 100 WHEN n % 2 = 0 THEN n * 10 ELSE n END AS n FROM n",
    "for_each_track": f"{_F} SELECT rec, o AS output_idx, 1.0::DOUBLE AS peak FROM frames, (SELECT unnest([0, 1]) AS o) GROUP BY ALL",
    "fan_out": f"{_F} SELECT rec, n_name AS target, round(sum(x * n_nationkey), 5) AS total FROM frames, nation GROUP BY ALL",
    "stage_metrics": f"WITH {v.SQL['ev']}, n AS (SELECT CAST(rec AS VARCHAR) AS run, CASE WHEN user_id % 3 > 0 THEN 'parallel[' || user_id % 3 || '].' ELSE '' END || event_type AS stage, start_ms FROM ev) SELECT run, stage, round((max(start_ms) - min(start_ms)) / 1000.0::DOUBLE, 3) AS duration FROM n GROUP BY ALL UNION ALL SELECT run, 'total', round((max(start_ms) - min(start_ms)) / 1000.0::DOUBLE, 3) FROM n GROUP BY run",
    "utterance_embeddings": f"""{_F}, {_N}, k AS (SELECT rec, n, greatest(0, n - 4) // 4 AS k, greatest(0, n - 4) % 4 AS r FROM n), w AS (SELECT rec, unnest(range(k + CASE WHEN k = 0 OR (r + 4) / 8.0::DOUBLE >= 0.8::DOUBLE THEN 1 ELSE 0 END)) AS i FROM k),
p AS (SELECT w.rec, i, coalesce(sum(x), 0) / 8 AS a, coalesce(sum(prob), 0) / 8 AS b FROM w LEFT JOIN frames f ON f.rec = w.rec AND frame >= 4 * i AND frame < 4 * i + 8 GROUP BY ALL), q AS (SELECT rec, avg(a) AS a, avg(b) AS b FROM p GROUP BY rec)
SELECT rec AS utt, round(a / greatest(sqrt(a * a + b * b), 1e-8), 6) AS a, round(b / greatest(sqrt(a * a + b * b), 1e-8), 6) AS b FROM q""",
    "valid_targets": "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'not 64 weights' WHEN vec_id % 5 = 0 THEN 'not finite' END AS error FROM embeddings",
}
