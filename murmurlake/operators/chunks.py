"""Cutting long signals into overlapping chunks and stitching them back.

Chunks and stitched blocks are keyed by (signal, chunk or block), never by recording, so a long recording spreads over tasks.
What tells signals apart is signals.KEYS: the recording, its channel, and the output of a model, where they are there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import cutout, keys, lengths


@dataclass(frozen=True)
class ChunkConfig:
    seconds: float
    overlap: float
    blend: str
    rate: int

    @property
    def chunk(self) -> int:
        return max(1, int(self.seconds * self.rate))

    @property
    def shared(self) -> int:
        return int(self.chunk * self.overlap)

    @property
    def stride(self) -> int:
        return max(1, self.chunk - self.shared)


#: Seconds, overlap, blend and rate of the known kinds of models.
PRESETS = {"music": (7.8, 0.25, "triangular", 44100), "super_resolution": (4.0, 0.25, "discard", 48000), "enhance_48k": (4.0, 0.25, "discard", 48000), "enhance_16k": (4.0, 0.25, "triangular", 16000), "separate_16k": (4.0, 0.25, "discard", 16000), "gan": (1.594, 0.0, "none", 16000)}


def preset(name: str, rate: int | None = None) -> ChunkConfig:
    s, o, b, r = PRESETS[name]
    return ChunkConfig(s, o, b, rate or r)


def chunk_plan(recordings: DataFrame, config: ChunkConfig, discard: bool = False) -> DataFrame:
    """By signal, chunk_idx, start_frame, n_frames, total, is_first, is_last from (rec, total).

    Starts are 0, stride, ... below total; a recording that fits one chunk is one, of its own length. With discard, chunks
    go on while start + chunk <= total + stride, and the first always exists.
    """
    n, stride = config.chunk, config.stride
    total = F.col("total")
    end = F.greatest(F.lit(0), total + stride - n) if discard else total - 1
    starts = F.when(total <= n, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), end.cast("long"), F.lit(stride).cast("long")))
    own = keys(recordings)
    x = recordings.where("total > 0").select(*own, "total", F.size(starts).alias("k"), F.posexplode(starts).alias("chunk_idx", "start_frame"))
    return x.select(*own, "chunk_idx", "start_frame", F.when(total <= n, total).otherwise(F.lit(n)).cast("long").alias("n_frames"), "total", (F.col("chunk_idx") == 0).alias("is_first"), (F.col("chunk_idx") == F.col("k") - 1).alias("is_last"))


def make_chunks(signals: DataFrame, config: ChunkConfig, discard: bool = False) -> DataFrame:
    """The plan with samples, zero where the signal has ended. Each block goes to the chunks that it is part of, no more."""
    own = keys(signals)
    plan = chunk_plan(lengths(signals).withColumnRenamed("n", "total"), config, discard)
    n, stride = config.chunk, config.stride
    end = F.col("start_frame") + F.size("samples")
    first = F.greatest(F.lit(0), F.floor((F.col("start_frame") - n) / stride) + 1)
    parts = signals.where(F.size("samples") > 0).select(*own, F.col("start_frame").alias("b"), "samples", F.explode(F.sequence(first, F.floor((end - 1) / stride))).alias("chunk_idx"))
    x = parts.join(plan.withColumn("chunk_idx", F.col("chunk_idx").cast("long")), [*own, "chunk_idx"])
    lo, hi = F.greatest("b", "start_frame"), F.least(F.col("b") + F.size("samples"), F.col("start_frame") + F.col("n_frames"))
    what = [*own, "chunk_idx", "start_frame", "n_frames", "total", "is_first", "is_last"]
    x = x.where(hi > lo).select(*what, F.struct(lo.alias("at"), cutout("samples", (lo - F.col("b") + 1).cast("int"), (hi - lo).cast("int")).alias("s")).alias("p"))
    g = x.groupBy(*what).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    flat = F.flatten(F.transform("ps", lambda p: p["s"]))
    return g.select(*what, F.concat(flat, F.array_repeat(F.lit(0.0), (F.col("n_frames") - F.size(flat)).cast("int"))).alias("samples"))


def segment(signals: DataFrame, seconds: float = 2.0, rate: int = 32_000) -> DataFrame:
    """Chunks without overlap, all of one length: the last is padded with silence; reassemble crops it again."""
    n = max(1, int(seconds * rate))
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - F.size("samples")))
    return make_chunks(signals, ChunkConfig(seconds, 0.0, "none", rate)).withColumn("samples", F.concat("samples", pad))


def reassemble(segments: DataFrame) -> DataFrame:
    """The signals that segment() has cut, without the padding."""
    own = keys(segments)
    return segments.select(*own, F.col("chunk_idx").alias("block_idx"), "start_frame", cutout("samples", 1, F.least(F.size("samples").cast("long"), F.col("total") - F.col("start_frame")).cast("int")).alias("samples"))


def _trimmed(chunks: DataFrame, head: Column, keep: Column) -> DataFrame:
    left = F.least(keep, F.col("total") - F.col("start_frame") - head)
    return chunks.where(left > 0).select(*keys(chunks), F.col("chunk_idx").alias("block_idx"), (F.col("start_frame") + head).alias("start_frame"), cutout("samples", (head + 1).cast("int"), left.cast("int")).alias("samples"))


def stitch_none(chunks: DataFrame, config: ChunkConfig) -> DataFrame:
    """One stride from each chunk, the last whole."""
    return _trimmed(chunks, F.lit(0), F.when(F.col("is_last"), F.size("samples")).otherwise(config.stride))


def stitch_discard(chunks: DataFrame, config: ChunkConfig) -> DataFrame:
    """Half the overlap is given up at every edge but the first chunk's head; what the last chunk then doesn't reach is silent. A frame that two chunks keep is the later one's."""
    up = config.shared // 2
    head = F.when(F.col("is_first"), 0).otherwise(up)
    reach = F.least(F.when(F.col("is_last"), config.chunk - up).otherwise(config.stride + up), F.size("samples"), F.col("total") - F.col("start_frame"))
    kept = cutout("samples", (head + 1).cast("int"), (reach - head).cast("int"))
    silent = F.when(F.col("is_last"), F.col("total") - F.col("start_frame") - F.greatest(reach, head)).otherwise(0)
    x = chunks.select(*keys(chunks), F.col("chunk_idx").alias("block_idx"), (F.col("start_frame") + head).alias("start_frame"), F.concat(kept, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), silent.cast("int")))).alias("samples"))
    return x.where(F.size("samples") > 0)


def weights(n: Column, blend: str, config: ChunkConfig, first: Column, last: Column, flat: bool) -> Column:
    """A chunk's weights. triangular: up to the middle and down; hann: sin^2, and if flat 1 where no neighbour reaches: a first chunk's stride, a last one's part after the overlap."""
    i = F.sequence(F.lit(0), n - 1)
    if blend == "triangular":
        half = (n / 2).cast("int")
        return F.transform(i, lambda k: F.when(n <= 1, 1.0).when(k < half, (k + 1) / F.greatest(half, F.lit(1))).otherwise((n - k) / F.greatest(half, F.lit(1))))
    w = lambda k: F.when(n > 1, F.sin(F.lit(3.141592653589793) * k / (n - 1)) ** 2).otherwise(1.0)
    if not flat:
        return F.transform(i, w)
    return F.transform(i, lambda k: F.when((first & (k < config.stride)) | (last & (k >= config.shared)), 1.0).otherwise(w(k)))


def stitch_weighted(chunks: DataFrame, config: ChunkConfig, blend: str = "triangular", flat: bool = True) -> DataFrame:
    """Weighted mean of all chunks at each frame; 0 where no weight is. Output blocks are one stride long.

    Each chunk sends its share of a block, already weighted, once; a block's few shares are added up as arrays.
    """
    own, stride = keys(chunks), config.stride
    n = F.size("samples")
    x = chunks.withColumn("w", weights(n, blend, config, F.col("is_first"), F.col("is_last"), flat))
    x = x.withColumn("block_idx", F.explode(F.sequence(F.col("chunk_idx").cast("long"), F.floor((F.least(F.col("start_frame") + n, F.col("total")) - 1) / stride))))
    lo = F.col("block_idx") * stride
    k = F.least(F.lit(stride), F.least(F.col("start_frame") + n, F.col("total")) - lo).cast("int")
    at = (lo - F.col("start_frame") + 1).cast("int")
    x = x.select(*own, "block_idx", F.transform(F.arrays_zip(cutout("samples", at, k).alias("s"), cutout("w", at, k).alias("w")), lambda z: F.struct((z["s"] * z["w"]).alias("v"), z["w"].alias("w"))).alias("z"), "chunk_idx")
    g = x.groupBy(*own, "block_idx").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "z"))).alias("zs"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    add = F.aggregate(F.transform("zs", lambda q: q["z"]), F.array().cast("array<struct<v:double,w:double>>"), lambda a, z: F.zip_with(a, z, lambda p, q: F.struct((zero(p["v"]) + zero(q["v"])).alias("v"), (zero(p["w"]) + zero(q["w"])).alias("w"))))
    return g.select(*own, "block_idx", (F.col("block_idx") * stride).alias("start_frame"), F.transform(add, lambda z: F.when(z["w"] > 1e-8, z["v"] / z["w"]).otherwise(0.0)).alias("samples"))


def stitch(chunks: DataFrame, config: ChunkConfig, blend: str | None = None, flat: bool = True) -> DataFrame:
    blend = blend or config.blend
    if blend == "none":
        return stitch_none(chunks, config)
    if blend == "discard":
        return stitch_discard(chunks, config)
    return stitch_weighted(chunks, config, blend, flat)


def stitch_multi(chunks: DataFrame, config: ChunkConfig, blend: str = "triangular") -> DataFrame:
    """The same for several outputs of each chunk (output_idx, one of KEYS), in one pass."""
    return stitch_weighted(chunks, config, blend)


def covered_share(plan: DataFrame) -> DataFrame:
    """By signal, chunks, frames: how often the plan reads a frame."""
    return plan.groupBy(*keys(plan)).agg(F.count("*").alias("chunks"), F.sum("n_frames").alias("frames"), F.max("start_frame").alias("last_start"))
