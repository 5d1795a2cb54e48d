"""Speech activity: segments from frame probabilities, masks, trimming, gating, processing of speech alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import interval_join
from ..functions.windows import islands, running, shard_of
from .signals import cutout, keys, lengths, reblock, slice_frames

FRAME_MS = 256
MASK_MS = 17


def segments_from_probs(frames: DataFrame, threshold: float = 0.5, min_speech: int = 250, min_silence: int = 400, frame_ms: int = FRAME_MS, shard: int = 100_000) -> DataFrame:
    """rec, start_ms, end_ms of speech: runs of frames at or over the threshold, joined over shorter silences, short ones dropped."""
    x = frames.where(F.col("prob") >= threshold).select("rec", "frame", (F.col("frame") * frame_ms).alias("start_ms"), ((F.col("frame") + 1) * frame_ms).alias("end_ms"))
    x = islands(x, ["rec"], "start_ms", "end_ms", ["frame"], shard_of("frame", shard), gap=min_silence, closed=False)
    x = x.groupBy("rec", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return x.where(F.col("end_ms") - F.col("start_ms") >= min_speech).drop("island")


def frame_mask(frames: DataFrame, durations: DataFrame, threshold: float = 0.5, frame_ms: int = FRAME_MS, mask_ms: int = MASK_MS) -> DataFrame:
    """rec, i, speech: decisions by frame on a finer grid of duration_ms / mask_ms steps; start inclusive, end exclusive, so frames never meet."""
    hot = frames.where(F.col("prob") >= threshold).join(durations, "rec")
    n = F.floor(F.col("duration_ms") / mask_ms)
    a, b = F.floor(F.col("frame") * frame_ms / mask_ms), F.least(F.floor((F.col("frame") + 1) * frame_ms / mask_ms), n)
    return hot.where(b > a).select("rec", F.explode(F.sequence(a, b - 1)).alias("i"))


def speech_bounds(vad: DataFrame, recordings: DataFrame, pad: int = 10) -> DataFrame:
    """Where to trim each recording: first speech start to last speech end and `pad` ms; all of it if there is no speech."""
    ends = vad.groupBy("rec").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    x = recordings.join(ends, "rec", "left")
    some = F.coalesce(F.col("b") > F.col("a"), F.lit(False))
    return x.select("rec", F.when(some, F.col("a")).otherwise(F.lit(0)).alias("start_ms"), F.when(some, F.least(F.col("b") + pad, F.col("total_ms"))).otherwise(F.col("total_ms")).alias("end_ms"))


def trim_by_segments(signals: DataFrame, vad: DataFrame, rate: int, pad: int = 10) -> DataFrame:
    """signals from the first speech start to the last speech end and `pad` ms; unchanged where there is no speech."""
    total = lengths(signals).withColumn("total_ms", F.col("n") * 1000 / rate)
    cut = speech_bounds(vad, total.select("rec", "total_ms").groupBy("rec").agg(F.max("total_ms").alias("total_ms")), pad)
    frame = lambda c: F.floor(F.col(c) * rate / 1000).cast("long")
    return slice_frames(signals, cut.select("rec", frame("start_ms").alias("lo"), frame("end_ms").alias("hi")))


def trim_to_speech(signals: DataFrame, mask: DataFrame, rate: int, mask_ms: int = MASK_MS) -> tuple[DataFrame, DataFrame]:
    """signals from the first to the last frame of the mask (rec, i: frames with speech) and the mask between, from 0.

    Where no frame has speech, or what is left would be empty, the signal stays and all of its frames are in the mask.
    """
    n = lengths(signals).groupBy("rec").agg(F.max("n").alias("n"))
    ends = mask.groupBy("rec").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    lo = F.greatest(F.lit(0), F.floor(F.col("a") * mask_ms * rate / 1000)).cast("long")
    hi = F.least(F.col("n"), F.floor((F.col("b") + 1) * mask_ms * rate / 1000)).cast("long")
    x = n.join(ends, "rec", "left").withColumn("some", F.coalesce(lo < hi, F.lit(False)))
    x = x.select("rec", "a", "b", "n", "some", F.when(F.col("some"), lo).otherwise(F.lit(0)).alias("lo"), F.when(F.col("some"), hi).otherwise(F.col("n")).alias("hi"))
    kept = mask.join(x.where("some").select("rec", "a"), "rec").select("rec", (F.col("i") - F.col("a")).alias("i"))
    every = x.where("NOT some").select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor(F.col("n") * 1000 / rate / mask_ms) - 1))).alias("i"))
    return slice_frames(signals, x), kept.unionByName(every)


def resample_mask(mask: Column, n: Column) -> Column:
    """The nearest of mask's values for each of n places."""
    size = F.size(mask)
    return F.when((n > 0) & (size > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(mask, F.least(F.floor(i * size / n).cast("int"), size - 1)))).otherwise(F.slice(mask, 1, 0))


def gate_chunks(chunks: DataFrame, vad: DataFrame, target: int = 160_000, frames: int = 4096, shard: int = 10_000) -> DataFrame:
    """Chunks (rec, chunk_idx, start_ms, end_ms) that overlap speech, with the batch of about `target` samples each is in."""
    met = interval_join(chunks.select("rec", "chunk_idx", "start_ms", "end_ms"), vad.select("rec", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end")), ["rec"])
    kept = chunks.join(met.select("rec", "chunk_idx").distinct(), ["rec", "chunk_idx"], "left_semi")
    nth = running(kept, ["rec"], ["chunk_idx"], shard_of("chunk_idx", shard), {"nth": ("sum", F.lit(1).cast("long"), False)})
    return nth.withColumn("batch_id", F.floor(F.coalesce("nth", F.lit(0)) / -(-target // frames))).drop("nth")


def concat_ranges(signals: DataFrame, ranges: DataFrame, rate: int, size: int = 48_000) -> DataFrame:
    """One signal of what lies within ranges (rec, start_ms, end_ms; they don't overlap), in order, without the gaps."""
    own = keys(signals)
    frame = lambda c: F.floor(F.col(c) * rate / 1000).cast("long")
    r = ranges.select("rec", frame("start_ms").alias("lo"), frame("end_ms").alias("hi"))
    end = F.col("start_frame") + F.size("samples")
    # Every block meets the ranges in the buckets of a block's length that it touches, so no signal is one group.
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor((b - 1) / size)))
    r = r.where("hi > lo").withColumn("bucket", span(F.col("lo"), F.col("hi")))
    x = reblock(signals, size).withColumn("bucket", span(F.col("start_frame"), end)).join(r, ["rec", "bucket"])
    a, b = F.greatest("start_frame", "lo"), F.least(end, F.col("hi"))
    parts = x.where(b > a).select(*own, F.col("block_idx").alias("at_block"), a.alias("a"), cutout("samples", (a - F.col("start_frame") + 1).cast("int"), (b - a).cast("int")).alias("samples"))
    placed = running(parts.withColumn("size", F.size("samples").cast("long")), own, ["a"], F.col("at_block"), {"start_frame": ("sum", "size", False), "block_idx": ("sum", F.lit(1).cast("long"), False)})
    return placed.select(*own, F.coalesce("block_idx", F.lit(0)).alias("block_idx"), F.coalesce("start_frame", F.lit(0)).alias("start_frame"), "samples")


def process_gated(signals: DataFrame, vad: DataFrame, rate: int, fn: Callable[[DataFrame], DataFrame], size: int = 48_000) -> DataFrame:
    """signals with speech put through fn, the rest as it was.

    fn takes and returns signals whose KEYS tell segments apart: a segment is an output_idx of its own, from frame 0, and
    fn keeps its length. Segments (rec, start_ms, end_ms) don't overlap. What fn returns is put back where it came from.
    """
    own = [k for k in keys(signals) if k != "output_idx"]
    frame = lambda c: F.floor(F.col(c) * rate / 1000).cast("long")
    r = vad.select("rec", frame("start_ms").alias("lo"), frame("end_ms").alias("hi")).where("hi > lo")
    done = fn(_segments(signals.drop("output_idx"), r))
    put = done.select(*own, (F.col("start_frame") + F.col("output_idx")).alias("start_frame"), "samples")
    # A frame that was processed takes the place of the one that was there: later parts of a block win.
    old = reblock(signals, size).select(*own, "block_idx", "start_frame", "samples")
    new = reblock(put.withColumn("block_idx", F.lit(0)), size).select(*own, "block_idx", F.col("start_frame").alias("at"), F.col("samples").alias("new"))
    mask = _covered(put, size, own)
    g = old.join(new, [*own, "block_idx"], "left").join(mask, [*own, "block_idx"], "left").withColumn("spans", F.array_sort("spans"))
    # Spans don't overlap: what lies before one and after the last is the block's, the rest is new, piece by piece.
    start, end = F.col("start_frame"), F.col("start_frame") + F.size("samples")
    within = lambda t: F.least(F.greatest(t, start), end)
    piece = lambda of, begin, lo, hi: cutout(of, (lo - begin + 1).cast("int"), (hi - lo).cast("int"))
    before = lambda i: F.when(i == 0, start).otherwise(within(F.get("spans", i - 1)["b"]))
    parts = F.transform("spans", lambda s, i: F.concat(piece("samples", start, before(i), within(s["a"])), piece("new", F.col("at"), within(s["a"]), within(s["b"]))))
    merged = F.concat(F.flatten(parts), piece("samples", start, within(F.element_at("spans", -1)["b"]), end))
    return g.select(*own, "block_idx", "start_frame", F.when(F.col("spans").isNull(), F.col("samples")).otherwise(merged).alias("samples"))


def _segments(signals: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each range of a signal as a signal of its own, told apart by where it starts."""
    x = signals.join(ranges, "rec")
    a, b = F.greatest("start_frame", "lo"), F.least(F.col("start_frame") + F.size("samples"), F.col("hi"))
    return x.where(b > a).select(*keys(signals), F.col("lo").alias("output_idx"), "block_idx", (a - F.col("lo")).alias("start_frame"), cutout("samples", (a - F.col("start_frame") + 1).cast("int"), (b - a).cast("int")).alias("samples"))


def _covered(parts: DataFrame, size: int, own: list[str]) -> DataFrame:
    """By block, the spans of frames that parts hold."""
    end = F.col("start_frame") + F.size("samples")
    x = parts.where(F.size("samples") > 0).withColumn("block_idx", F.explode(F.sequence(F.floor(F.col("start_frame") / size), F.floor((end - 1) / size))))
    return x.groupBy(*own, "block_idx").agg(F.collect_list(F.struct(F.col("start_frame").alias("a"), end.alias("b"))).alias("spans"))
