"""Signals in blocks: slices, mixes, levels, comparisons, resampling, quality checks.

A signal is rows of (rec, channel, block_idx, start_frame, samples). `rec` may be of any type; `channel` may be left out,
and where it is there, each channel is a signal of its own (KEYS). A block is an array of consecutive samples; blocks of a
signal need no equal length. Sums are made block by block, so a recording of any length is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUM = lambda xs, f=lambda x: x: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
KEYS = ("rec", "channel", "output_idx", "target")
BLOCK = ["block_idx", "start_frame", "samples"]


def keys(*signals: DataFrame) -> list[str]:
    """What tells signals apart: those of KEYS that all of them have."""
    return [k for k in KEYS if all(k in s.columns for s in signals)]


def blocks_of(read: DataFrame) -> DataFrame:
    """What read_wav gives, as signals in doubles."""
    return read.where("status = 'ok'").select("rec", "channel", "block_idx", "start_frame", F.col("samples").cast("array<double>").alias("samples"))


def schema_of(df: DataFrame, names: list[str], more: str) -> str:
    """DDL of some of df's columns and of further ones."""
    return ", ".join([*(f"{n} {df.schema[n].dataType.simpleString()}" for n in names), more])


def cutout(samples: str | Column, at: int | Column, n: int | Column) -> Column:
    """slice() with a start of at least 1 and a length of at least 0, as filters may be evaluated later."""
    lit = lambda c: F.lit(c) if isinstance(c, int) else c
    return F.slice(samples, F.greatest(F.lit(1), lit(at)), F.greatest(F.lit(0), lit(n)))


def joined(parts: Column) -> Column:
    """Struct of the first frame and all samples of parts (at, s), which are in order; what lies between them is silent."""
    start = F.struct(parts[0]["at"].alias("next"), F.array().cast("array<double>").alias("s"))
    whole = F.aggregate(parts, start, lambda a, p: F.struct((p["at"] + F.size(p["s"])).alias("next"), F.concat(a["s"], F.array_repeat(F.lit(0.0), (p["at"] - a["next"]).cast("int")), p["s"]).alias("s")))
    return F.struct(parts[0]["at"].alias("at"), whole["s"].alias("s"))


def reblock(signals: DataFrame, size: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of `size` frames cut at its multiples; frames without samples between others are 0. Columns `more`, of one value in a signal, come along."""
    own = [*keys(signals), *more]
    end = F.col("start_frame") + F.size("samples")
    x = signals.where(F.size("samples") > 0).withColumn("b", F.explode(F.sequence(F.floor(F.col("start_frame") / size), F.floor((end - 1) / size))))
    lo, hi = F.greatest(F.col("start_frame"), F.col("b") * size), F.least(end, (F.col("b") + 1) * size)
    x = x.select(*own, F.col("b").alias("block_idx"), lo.alias("at"), cutout(F.col("samples").cast("array<double>"), (lo - F.col("start_frame") + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    g = x.groupBy(*own, "block_idx").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("parts")).withColumn("whole", joined(F.col("parts")))
    return g.select(*own, "block_idx", F.col("whole.at").alias("start_frame"), F.col("whole.s").alias("samples"))


def slice_signal(signals: DataFrame, ranges: DataFrame, rate: int) -> DataFrame:
    """The part of each signal between start and end seconds, from frame 0; nothing where they are NaN or empty."""
    lo = F.when(F.isnan("start"), None).otherwise(F.greatest(F.lit(0.0), F.col("start") * rate)).cast("long")
    hi = F.when(F.isnan("end"), None).otherwise(F.least(F.lit(9e15), F.greatest(F.lit(0.0), F.col("end") * rate))).cast("long")
    return slice_frames(signals, ranges.select(*keys(signals, ranges), lo.alias("lo"), hi.alias("hi")))


def slice_frames(signals: DataFrame, ranges: DataFrame) -> DataFrame:
    """The frames lo .. hi of each signal, from frame 0."""
    on = keys(signals, ranges)
    x = signals.join(ranges.select(*on, "lo", "hi"), on)
    a, b = F.greatest("start_frame", "lo"), F.least(F.col("start_frame") + F.size("samples"), F.col("hi"))
    return x.where(b > a).select(*keys(signals), "block_idx", (a - F.col("lo")).alias("start_frame"), cutout("samples", (a - F.col("start_frame") + 1).cast("int"), (b - a).cast("int")).alias("samples"))


def shifted(signals: DataFrame, frames: int | Column) -> DataFrame:
    return signals.withColumn("start_frame", F.col("start_frame") + (F.lit(frames) if isinstance(frames, int) else frames))


def lengths(signals: DataFrame) -> DataFrame:
    return signals.groupBy(*keys(signals)).agg(F.max(F.col("start_frame") + F.size("samples")).alias("n"))


def replace_range(signals: DataFrame, ranges: DataFrame, replacement: DataFrame) -> DataFrame:
    """signals with frames lo..hi of ranges (rec, lo, hi) replaced, whatever the replacement's length; a range outside changes nothing."""
    own = keys(signals)
    n = lengths(signals)
    on = keys(ranges, signals)
    r = n.join(ranges, on).select(*own, F.least(F.greatest("lo", F.lit(0)), "n").alias("lo"), F.least(F.greatest("hi", F.lit(0)), "n").alias("hi")).where("hi > lo")
    put = lengths(replacement).withColumnRenamed("n", "m")
    x = signals.join(r, own, "left").join(put, keys(signals, put), "left")
    size, start = F.size("samples"), F.col("start_frame")
    whole = x.where("hi IS NULL OR m IS NULL").select(*own, *BLOCK)
    x = x.where("hi IS NOT NULL AND m IS NOT NULL")
    head = x.where(start < F.col("lo")).select(*own, "block_idx", "start_frame", cutout("samples", 1, F.least(size.cast("long"), F.col("lo") - start).cast("int")).alias("samples"))
    cut = F.greatest(F.lit(0), F.col("hi") - start)
    tail = x.where(start + size > F.col("hi")).select(*own, "block_idx", (start + cut - F.col("hi") + F.col("lo") + F.col("m")).alias("start_frame"), cutout("samples", (cut + 1).cast("int"), (size - cut).cast("int")).alias("samples"))
    mid = replacement.join(r, keys(replacement, r)).select(*own, "block_idx", (start + F.col("lo")).alias("start_frame"), "samples")
    return whole.unionByName(head).unionByName(mid).unionByName(tail)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b over the shorter length. Both in equal blocks (reblock)."""
    own = keys(a, b)
    x = a.join(b.select(*own, "block_idx", F.col("samples").alias("other")), [*own, "block_idx"])
    n = F.least(F.size("samples"), F.size("other"))
    return x.select(*own, "block_idx", "start_frame", F.zip_with(cutout("samples", 1, n), cutout("other", 1, n), lambda p, q: p - q).alias("samples"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def add_stems(*stems: DataFrame, size: int = 4096) -> DataFrame:
    """The sum over the union of all timelines; samples that aren't finite are 0."""
    own = keys(*stems)
    parts = None
    for s in stems:
        y = reblock(s, size).select(*own, "block_idx", F.concat(F.array_repeat(F.lit(0.0), (F.col("start_frame") - F.col("block_idx") * size).cast("int")), F.transform("samples", _finite)).alias("s"))
        parts = y if parts is None else parts.unionByName(y)
    total = F.aggregate(F.collect_list("s"), F.array().cast("array<double>"), lambda a, s: F.zip_with(a, s, lambda p, q: _zero(p) + _zero(q)))
    return parts.groupBy(*own, "block_idx").agg(total.alias("samples")).select(*own, "block_idx", (F.col("block_idx") * size).alias("start_frame"), "samples")


def mix(a: DataFrame, b: DataFrame, offset: int, size: int = 4096) -> DataFrame:
    """a and b, b starting `offset` frames in; a negative offset moves a to the right. Gaps are silent."""
    start = F.least(F.lit(0), F.lit(offset))
    return add_stems(shifted(a, -start), shifted(b, offset - start), size=size)


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    own = keys(a, b)
    far = a.groupBy(*own).agg(F.max(F.col("start_frame") + F.size("samples")).alias("n"), (F.max("block_idx") + 1).alias("k"))
    return a.select(*own, *BLOCK).unionByName(b.join(far, own, "left").select(*own, (F.col("block_idx") + F.coalesce("k", F.lit(0))).alias("block_idx"), (F.col("start_frame") + F.coalesce("n", F.lit(0))).alias("start_frame"), "samples"))


def scale(signals: DataFrame, k: float | Column) -> DataFrame:
    k = F.lit(float(k)) if isinstance(k, (int, float)) else k
    return signals.withColumn("samples", F.transform("samples", lambda x: x * k))


def to_pcm16(signals: DataFrame) -> DataFrame:
    return signals.withColumn("samples", F.transform("samples", lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int")))


# ---------------------------------------------------------------- channels


def mono(signals: DataFrame) -> DataFrame:
    """The mean of channels (rec, channel, block_idx, start_frame, samples), which lie in equal blocks. A group is a block's channels."""
    own = [k for k in keys(signals) if k != "channel"]
    total = F.aggregate("cs", F.array().cast("array<double>"), lambda a, s: F.zip_with(a, s, lambda p, q: _zero(p) + _zero(q)))
    x = signals.groupBy(*own, "block_idx", "start_frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda c: c["samples"]).alias("cs"))
    return x.select(*own, "block_idx", "start_frame", F.transform(total, lambda v: v / F.size("cs")).alias("samples"))


def duplicate_channels(signals: DataFrame, n: int) -> DataFrame:
    return signals.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def convert_channels(signals: DataFrame, n: int | DataFrame) -> DataFrame:
    """Signals with n channels each, or as many as n (rec, channels) asks for: those that have n stay; one is the mean; more are copies of the mean."""
    own = [k for k in keys(signals) if k != "channel"]
    have = signals.groupBy(*own).agg(F.count_distinct("channel").alias("have"))
    have = have.withColumn("want", F.lit(n)) if isinstance(n, int) else have.join(n.select("rec", F.col("channels").alias("want")), "rec")
    return converted(signals.select(*own, "channel", *BLOCK).join(have, own))


def converted(signals: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """convert_channels() of signals with what they `have` and `want`: one pass over groups of a block's channels, whether they stay or not."""
    own = [k for k in keys(signals) if k != "channel"]
    each = F.struct("channel", F.col("samples").cast("array<double>").alias("samples"))
    x = signals.groupBy(*own, *more, "have", "want", "block_idx", "start_frame").agg(F.array_sort(F.collect_list(each)).alias("all"))
    total = F.aggregate(F.transform("all", lambda c: c["samples"]), F.array().cast("array<double>"), lambda a, s: F.zip_with(a, s, lambda p, q: _zero(p) + _zero(q)))
    x = x.withColumn("mean", F.when(F.col("have") != F.col("want"), F.transform(total, lambda v: v / F.size("all"))))
    channels = F.sequence(F.lit(0), F.greatest(F.col("want").cast("int"), F.lit(1)) - 1)
    copies = F.transform(channels, lambda c: F.struct(c.cast(signals.schema["channel"].dataType).alias("channel"), F.col("mean").alias("samples")))
    made = F.when(F.col("have") == F.col("want"), F.col("all")).when((F.col("have") != F.col("want")) & (F.col("want") > 0), copies)
    return x.select(*own, *more, "block_idx", "start_frame", F.explode(made).alias("c")).select(*own, F.col("c.channel").alias("channel"), *more, "block_idx", "start_frame", F.col("c.samples").alias("samples"))


def stereo_pair(signals: DataFrame) -> DataFrame:
    """Two channels: both of a pair, one channel twice, the mean of more than two twice."""
    return convert_channels(signals, 2)


def interleave(signals: DataFrame) -> DataFrame:
    """rec, block_idx, start_frame, channels, samples of blocks with all channels, frame by frame."""
    own = [k for k in keys(signals) if k != "channel"]
    x = signals.groupBy(*own, "block_idx", "start_frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda c: c["samples"]).alias("cs"))
    i = F.sequence(F.lit(0), F.array_max(F.transform("cs", F.size)) - 1)
    return x.select(*own, "block_idx", "start_frame", F.size("cs").alias("channels"), F.flatten(F.transform(i, lambda k: F.transform("cs", lambda c: F.get(c, k)))).alias("samples"))


def deinterleave(blocks: DataFrame) -> DataFrame:
    """The channels of interleaved blocks, one row each; samples that make no whole frame are left out."""
    own = [k for k in keys(blocks) if k != "channel"]
    x = blocks.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1))).withColumn("frames", F.floor(F.size("samples") / F.col("channels")).cast("int"))
    return x.where("frames > 0").select(*own, "channel", "block_idx", "start_frame", F.transform(F.sequence(F.lit(0), F.col("frames") - 1), lambda f: F.get("samples", (f * F.col("channels") + F.col("channel")).cast("int"))).alias("samples"))


# ---------------------------------------------------------------- levels and comparisons


def levels(signals: DataFrame, rate: int = 1) -> DataFrame:
    """By signal: rms, peak, dc, dur."""
    own = keys(signals)
    x = signals.select(*own, F.size("samples").alias("n"), _SUM(F.col("samples"), lambda v: v * v).alias("q"), _SUM(F.col("samples")).alias("s"), F.array_max(F.transform("samples", F.abs)).alias("p"))
    x = x.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("s").alias("s"), F.max("p").alias("peak"))
    return x.select(*own, F.sqrt(F.col("q") / F.col("n")).alias("rms"), "peak", (F.col("s") / F.col("n")).alias("dc"), (F.col("n") / rate).alias("dur"))


def normalize(signals: DataFrame, mode: str, target: float) -> DataFrame:
    """Two passes: levels, then a gain for each signal. peak: to target dB; rms: to target dB, at most to a peak of 0.99; floor: raise to an RMS of target."""
    own = keys(signals)
    db = 10 ** (target / 20)
    gain = {
        "peak": F.when(F.col("peak") > 0, db / F.col("peak")),
        "rms": F.when(F.col("rms") > 0, F.least(db / F.col("rms"), 0.99 / F.col("peak"))),
        "floor": F.when((F.col("rms") > 0) & (F.col("rms") < target), target / F.col("rms")),
    }[mode]
    return scale(signals.join(levels(signals).select(*own, F.coalesce(gain, F.lit(1.0)).alias("gain")), own), F.col("gain")).drop("gain")


def match_mixture(outputs: DataFrame, mixture: DataFrame) -> DataFrame:
    """outputs at the RMS of the mixture they come from, then divided by their peak where that is over 1; near-silent outputs keep their level."""
    own, on = keys(outputs), keys(outputs, mixture)
    wanted = levels(mixture).select(*on, F.col("rms").alias("wanted"))
    g = levels(outputs).join(wanted, on)
    gain = F.when(F.col("rms") > 1e-8, F.col("wanted") / F.col("rms")).otherwise(1.0)
    g = g.withColumn("gain", gain / F.greatest(F.lit(1.0), F.col("peak") * gain))
    return scale(outputs.join(g.select(*own, "gain"), own), F.col("gain")).drop("gain")


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    own = keys(a, b)
    x = a.join(b.select(*own, "block_idx", F.col("samples").alias("other")), [*own, "block_idx"])
    n = F.least(F.size("samples"), F.size("other"))
    p, q = cutout("samples", 1, n), cutout("other", 1, n)
    return x.select(*own, _SUM(F.zip_with(p, q, lambda u, v: u * v)).alias("xy"), _SUM(p, lambda u: u * u).alias("xx"), _SUM(q, lambda u: u * u).alias("yy"), _SUM(F.zip_with(p, q, lambda u, v: (u - v) * (u - v))).alias("dd")).groupBy(*own).agg(*(F.sum(c).alias(c) for c in ("xy", "xx", "yy", "dd")))


def snr(a: DataFrame, b: DataFrame) -> DataFrame:
    """By signal, db: a's energy over that of a - b; infinite for equal signals."""
    return _paired(a, b).select(*keys(a, b), F.when(F.col("dd") == 0, float("inf")).otherwise(10 * F.log10(F.col("xx") / F.col("dd"))).alias("db"))


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    return _paired(a, b).select(*keys(a, b), F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("value"))


def tone_energy(signals: DataFrame, hz: float, rate: float) -> DataFrame:
    """rec, energy: amplitude of a frequency, by position in the whole recording."""
    w = 2 * np.pi * hz / rate
    part = lambda f: F.aggregate(F.transform("samples", lambda x, i: x * f((F.col("start_frame") + i) * w)), F.lit(0.0), lambda a, x: a + x)
    own = keys(signals)
    x = signals.select(*own, part(F.cos).alias("c"), part(F.sin).alias("s"), F.size("samples").alias("n")).groupBy(*own).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return x.select(*own, (2 * F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("n")).alias("energy"))


def qa(inputs: DataFrame, outputs: DataFrame, rate: int, expected_rate: int, channels: int = 1, expected_channels: int = 1) -> DataFrame:
    """By signal, problems of each output: non-finite samples first, which hide the others; silence; almost unchanged; length."""
    bad = lambda x: (F.isnan(x) | (F.abs(x) == float("inf")))
    own = keys(inputs, outputs)
    o = outputs.select(*own, "block_idx", "samples", F.size(F.filter("samples", bad)).alias("bad"))
    x = o.join(inputs.select(*own, "block_idx", F.col("samples").alias("given")), [*own, "block_idx"], "full_outer")
    n, m = F.greatest(F.coalesce(F.size("samples"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size("given"), F.lit(0)), F.lit(0))
    least = F.least(n, m)
    same = F.size(F.filter(F.zip_with(cutout("samples", 1, least), cutout("given", 1, least), lambda p, q: F.abs(p - q)), lambda d: d < 1e-4))
    x = x.select(*own, F.coalesce("bad", F.lit(0)).alias("bad"), n.alias("n"), m.alias("m"), F.greatest(F.coalesce(same, F.lit(0)), F.lit(0)).alias("same"), least.alias("both"), F.array_max(F.transform("samples", F.abs)).alias("peak"))
    x = x.groupBy(*own).agg(*(F.sum(c).alias(c) for c in ("bad", "n", "m", "same", "both")), F.max("peak").alias("peak"))
    rest = F.array(
        F.when(F.lit(rate != expected_rate), "sample rate"), F.when(F.lit(channels != expected_channels), "channels"), F.when(F.abs(F.col("n") - F.col("m")) > F.lit(expected_rate) / 10, "length"),
        F.when(F.coalesce("peak", F.lit(0.0)) < 0.01, "silent"), F.when((F.col("both") > 0) & (F.col("same") > 0.99 * F.col("both")), "unchanged"),
    )
    return x.select(*own, F.when(F.col("bad") > 0, F.array(F.lit("non-finite"))).otherwise(F.array_compact(rest)).alias("problems"))


def fit_length(samples: Column, n: int, mode: str = "zero") -> Column:
    """samples cut or padded to n, with zeros or by starting over."""
    if mode == "cycle":
        return F.when(F.size(samples) > 0, cutout(F.flatten(F.array_repeat(samples, F.ceil(F.lit(n) / F.size(samples)).cast("int"))), 1, n)).otherwise(F.array_repeat(F.lit(0.0), n))
    return cutout(F.concat(samples, F.array_repeat(F.lit(0.0), n)), 1, n)


# ---------------------------------------------------------------- with a halo: numpy by block


def with_halo(signals: DataFrame, before: int, after: int, size: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of `size` frames with the samples around them: KEYS, block_idx, start_frame, lead and trail (how many come before and after), samples, n (own samples).

    Only edges are sent to the neighbours; a block itself stays where reblock dealt it. Nothing more is needed to see where
    a signal ends: a last block has no trail.
    """
    own = [*keys(signals), *more]
    x = reblock(signals, size, more)
    end = F.col("start_frame") + F.size("samples")
    parts = []
    for k in range(1, -(-max(before, after, 1) // size) + 1):
        for to, lo, hi in ((F.col("block_idx") + k, (F.col("block_idx") + k) * size - before, end), (F.col("block_idx") - k, F.col("start_frame"), (F.col("block_idx") - k + 1) * size + after)):
            a, b = F.greatest("start_frame", lo), F.least(end, hi)
            parts.append(x.where(b > a).select(*own, to.alias("block_idx"), F.struct(a.cast("long").alias("at"), cutout("samples", (a - F.col("start_frame") + 1).cast("int"), (b - a).cast("int")).alias("s")).alias("part")))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    edges = edges.groupBy(*own, "block_idx").agg(F.collect_list("part").alias("parts"))
    mine = F.struct(F.col("start_frame").cast("long").alias("at"), F.col("samples").alias("s"))
    y = x.join(edges, [*own, "block_idx"], "left").withColumn("whole", joined(F.array_sort(F.concat(F.coalesce("parts", F.array().cast("array<struct<at:bigint,s:array<double>>>")), F.array(mine)))))
    lead = (F.col("start_frame") - F.col("whole.at")).cast("int")
    n = F.size("samples")
    return y.select(*own, "block_idx", "start_frame", lead.alias("lead"), (F.size("whole.s") - lead - n).alias("trail"), F.col("whole.s").alias("samples"), n.alias("n"))


HALO = 64


@lru_cache(maxsize=64)
def bank(rate: int, to: int) -> tuple[int, int, np.ndarray]:
    """Step and phases of a rational ratio, and the taps of each phase: a windowed sinc that cuts at 0.95 of the lower rate's half, of sum 1."""
    phases, step = to // math.gcd(rate, to), rate // math.gcd(rate, to)
    cut = min(1.0, to / rate) * 0.95
    d = np.arange(-HALO, HALO + 1)[None] - (np.arange(phases) / phases)[:, None]
    w = np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / (HALO + 1), -1, 1)))
    return step, phases, w / w.sum(axis=1, keepdims=True)


def filtered(x: np.ndarray, first: int, a: int, b: int, rate: int, to: int) -> np.ndarray:
    """Outputs a to b by a polyphase bank. x begins with frame `first`, and is held at its ends. Outputs of a phase lie `step` inputs apart: a view of x times one row of taps."""
    step, phases, taps = bank(rate, to)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, HALO, "edge"), 2 * HALO + 1)
    out = np.empty(b - a)
    for p in range(min(phases, b - a)):
        at, phase = divmod((a + p) * step, phases)
        made = out[p::phases]
        made[:] = windows[at - first :: step][: len(made)] @ taps[phase]
    return out


def resampled(x: np.ndarray, lead: int, start: int, n: int, total: int, rate: int, to: int, mode: str) -> tuple[int, np.ndarray]:
    """Output samples whose position lies in input frames start .. start + n; x holds them with what is around."""
    out_total = int(total * to / rate)
    a, b = -(-start * to // rate), min(out_total, -(-(start + n) * to // rate))
    if a >= b:
        return a, np.zeros(0)
    if mode == "high" or (mode == "auto" and to < rate):
        return a, filtered(x, start - lead, a, b, rate, to)
    t = np.arange(a, b) * rate / to - (start - lead)
    i = np.floor(t).astype(int)
    f = t - i
    at = lambda k: x[np.clip(k, 0, len(x) - 1)]
    if mode == "fast":
        return a, at(i) * (1 - f) + at(i + 1) * f
    p0, p1, p2, p3 = at(i - 1), at(i), at(i + 1), at(i + 2)
    return a, p1 + 0.5 * f * (p2 - p0 + f * (2 * p0 - 5 * p1 + 4 * p2 - p3 + f * (3 * (p1 - p2) + p3 - p0)))


def resample(signals: DataFrame, rate: int, to: int, mode: str = "balanced", size: int = 48_000) -> DataFrame:
    """Each signal at another rate. fast: linear; balanced: cubic; high: a band-limited polyphase bank; auto: cubic up, the bank down."""
    if rate == to:
        return signals
    return _resampled(with_halo(signals, _reach(rate, to), _reach(rate, to), size).withColumns({"rate": F.lit(rate), "to": F.lit(to)}), keys(signals), mode, signals)


def _reach(rate: int, to: int) -> int:
    """The end of a signal is seen when it lies in the halo; beyond, it is at least one output sample away."""
    return max(HALO + 2, 2 * -(-rate // to))


def _resampled(blocks: DataFrame, own: list[str], mode: str, like: DataFrame) -> DataFrame:
    """Blocks with their halo from `rate` to `to`, which are columns."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = []
            for r in pdf.itertuples():
                x = np.asarray(r.samples, float)
                made.append((r.start_frame, x[r.lead : r.lead + r.n]) if r.rate == r.to else resampled(x, r.lead, r.start_frame, r.n, r.start_frame + r.n + r.trail, int(r.rate), int(r.to), mode))
            yield pdf[[*own, "block_idx"]].assign(start_frame=[m[0] for m in made], samples=[m[1] for m in made])

    return blocks.mapInPandas(run, schema_of(like, own, "block_idx long, start_frame long, samples array<double>"))


def resample_each(signals: DataFrame, rates: DataFrame, mode: str = "balanced", size: int = 48_000) -> DataFrame:
    """resample() with rates (rec, rate, to) of each recording: one pass, however many pairs of rates there are."""
    rates = rates.select("rec", "rate", "to")
    return resample_own(signals.select(*keys(signals), *BLOCK).join(rates, "rec"), rates, mode, size).drop("to")


def resample_own(signals: DataFrame, rates: DataFrame, mode: str = "balanced", size: int = 48_000) -> DataFrame:
    """resample_each() of signals that hold their `rate` and `to` of rates, and keep `to`."""
    farthest = rates.agg(F.max(F.ceil(F.col("rate") / F.col("to")))).first()[0] or 1
    reach = _reach(int(farthest), 1)
    blocks = with_halo(signals, reach, reach, size, ("rate", "to"))
    return _resampled(blocks, [*keys(signals), "to"], mode, blocks)


def best_lag(a: DataFrame, b: DataFrame, max_lag: int = 64, size: int = 48_000) -> DataFrame:
    """By signal, the lag of b against a with the largest correlation sum (ties: the smallest)."""
    own = keys(a, b)
    x = with_halo(b, max_lag, max_lag, size).select(*own, "block_idx", "lead", F.col("start_frame").alias("b_start"), F.col("samples").alias("around")).join(reblock(a, size), [*own, "block_idx"])
    lags = np.arange(-max_lag, max_lag + 1)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                p, q = np.asarray(row.samples, float), np.asarray(row.around, float)
                # q[0] is frame b_start - lead; silence on either side stands for what isn't there.
                ahead = row.b_start - row.lead - (row.start_frame - max_lag)
                q = np.concatenate([np.zeros(max(0, ahead)), q[max(0, -ahead) :]])
                q = np.pad(q, (0, max(0, len(p) + 2 * max_lag - len(q))))[: len(p) + 2 * max_lag]
                yield pd.DataFrame({**{k: getattr(row, k) for k in own}, "lag": lags, "s": np.correlate(q, p, "valid")})

    s = x.mapInPandas(run, schema_of(a, own, "lag int, s double")).groupBy(*own, "lag").agg(F.sum("s").alias("s"))
    return s.groupBy(*own).agg(F.min(F.struct((-F.col("s")).alias("less"), "lag"))["lag"].alias("lag"))


def trim_silence(signals: DataFrame, top_db: float = 60, frame: int = 2048, hop: int = 512, size: int = 49_152) -> DataFrame:
    """By signal, lo, hi: from the first loud frame's hop to the end of the last one's `frame` samples. Two passes.

    Frames are centred at each hop, the signal's end among them, over mirrored ends; loud is what is less than top_db under the
    loudest. A signal of no more than half a frame stays, and so does one of which nothing would be left.
    """
    own_keys = keys(signals)
    half = frame // 2
    size = -(-size // hop) * hop

    def energy(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                x, until = np.asarray(r.samples, float), r.start_frame + r.n
                if until + r.trail <= max(1, half):
                    yield pd.DataFrame({**{k: [getattr(r, k)] for k in own_keys}, "at": [r.start_frame], "e": [1.0], "until": [until]})
                    continue
                left = half - r.lead  # where the signal begins nearer than that
                x = np.concatenate([x[1 : left + 1][::-1], x])
                lead = r.lead + left
                own = r.n // hop + 1 if not r.trail else -(-r.n // hop)
                need = lead + (own - 1) * hop + half
                if need > len(x):
                    x = np.concatenate([x, x[-2 : -2 - (need - len(x)) : -1]])
                mean = [float((x[lead + i * hop - half : lead + i * hop + half] ** 2).mean()) for i in range(own)]
                yield pd.DataFrame({**{k: getattr(r, k) for k in own_keys}, "at": r.start_frame + np.arange(own) * hop, "e": mean, "until": until})

    e = with_halo(signals, half, half, size).mapInPandas(energy, schema_of(signals, own_keys, "at long, e double, until long"))
    top = e.groupBy(*own_keys).agg(F.max("e").alias("top"), F.max("until").alias("total"))
    db = lambda c: 20 * F.log10(F.greatest(F.sqrt(c), F.lit(1e-10)))
    cut = e.join(top, own_keys).groupBy(*own_keys, "total").agg(*(f(F.when(db("e") > db("top") - top_db, F.col("at"))).alias(k) for f, k in ((F.min, "first"), (F.max, "last"))))
    hi = F.least(F.col("last") + frame, "total")
    left = F.col("first") < hi
    return cut.select(*own_keys, F.when(left, F.col("first")).otherwise(F.lit(0)).alias("lo"), F.when(left, hi).otherwise(F.col("total")).alias("hi"))


def trimmed(signals: DataFrame, top_db: float = 60, **options) -> DataFrame:
    """The signals without the silence before and after."""
    return slice_frames(signals, trim_silence(signals, top_db, **options))


def bandwidth(signals: DataFrame, rate: int, share: float = 0.99, window: int = 256, hop: int = 128, size: int = 48_128) -> DataFrame:
    """By signal, f_high, passthrough: the frequency under which `share` of the energy lies, and whether that is near the top."""
    own = keys(signals)

    def spectrum(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hann = np.hanning(window)
        for pdf in it:
            for r in pdf.itertuples():
                x = np.asarray(r.samples, float)[r.lead :]
                n = (min(len(x), r.n + window - hop) - window) // hop + 1
                if n < 1:
                    continue
                frames = np.lib.stride_tricks.sliding_window_view(x, window)[: n * hop : hop]
                yield pd.DataFrame({**{k: getattr(r, k) for k in own}, "bin": np.arange(window // 2 + 1), "e": (np.abs(np.fft.rfft(frames * hann)) ** 2).sum(axis=0)})

    bins = with_halo(signals, 0, window - hop, size).mapInPandas(spectrum, schema_of(signals, own, "bin int, e double")).groupBy(*own, "bin").agg(F.sum("e").alias("e"))
    w = Window.partitionBy(*own)
    x = bins.withColumn("run", F.sum("e").over(w.orderBy("bin"))).withColumn("all", F.sum("e").over(w))
    f = x.where(F.col("run") >= share * F.col("all")).groupBy(*own).agg((F.min("bin") * (rate / window)).alias("f_high"))
    return f.withColumn("passthrough", F.col("f_high") >= 0.95 * rate / 2)
