"""WAV files to blocks of samples and back, and synthetic signals."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.noise import noise
from .wav import ARROW, ROWS, SAMPLES, SIGNALS, read_format

MAX_SECONDS = 3600

#: Fixed value: frames that a synthetic channel is behind the one before it.
CHANNEL_DELAY = 13


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (frames x channels) of PCM16 or float32; ValueError for anything else."""
    form = read_format(lambda at, n: data[at : at + n], len(data))
    return form.rate, form.decode(data[form.at : form.at + form.size])


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A float32 file of samples (frames x channels)."""
    if not samples.size:
        raise ValueError("no samples")
    body = np.ascontiguousarray(samples, "<f4").tobytes()
    n = samples.shape[1]
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, n, rate, rate * n * 4, n * 4, 32) + b"data" + struct.pack("<I", len(body)) + body


def decode_files(files: DataFrame, block_frames: int = 48_000) -> DataFrame:
    """Planar blocks of the channels of files (path, content); a file that can't be read is one row whose status says why."""

    def rows(name: str, data: bytes) -> Iterator[dict]:
        try:
            rate, x = decode_wav(data)
        except ValueError as why:
            yield {"rec": name, "status": str(why)}
            return
        for k in range(0, len(x), block_frames):
            part = x[k : k + block_frames]
            yield from ({"rec": name, "channel": c, "sample_rate": rate, "block_idx": k // block_frames, "start_frame": k, "n_frames": len(part), "samples": part[:, c], "status": "ok"} for c in range(x.shape[1]))

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files one by one, and blocks handed on many at a time: what a file costs is its bytes, however short it is."""
        held, samples = [], 0
        for batch in it:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                for row in rows(name.as_py(), data.as_py()):
                    held.append(row)
                    samples += row.get("n_frames", 0)
                    if len(held) >= ROWS or samples >= SAMPLES:
                        yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                        held, samples = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)

    return files.select(F.col("path").cast("string"), "content").mapInArrow(blocks, SIGNALS)


def read_wav(spark: SparkSession, path: str, block_frames: int = 48_000) -> DataFrame:
    """decode_files of what lies under path."""
    return decode_files(spark.read.format("binaryFile").load(path), block_frames)


def split_ingest(signals: DataFrame, max_sec: float = MAX_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Blocks of recordings that are fine, and (rec, reason) of the others."""
    long_ = signals.groupBy("rec").agg(F.max((F.col("start_frame") + F.col("n_frames")) / F.col("sample_rate")).alias("sec"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("why"))
    reason = F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("sec") > max_sec, "too long")
    judged = long_.select("rec", reason.alias("reason"))
    return signals.join(judged.where("reason IS NULL").select("rec"), "rec", "left_semi"), judged.where("reason IS NOT NULL")


def to_wav(signals: DataFrame) -> DataFrame:
    """rec, content: one file for each recording (a file is one row by nature); channels that end earlier are silent from there on."""

    schema = f"rec {signals.schema['rec'].dataType.simpleString()}, content binary"
    form = to_arrow_schema(StructType.fromDDL(schema))

    def content(channels: list[int], samples: list[np.ndarray], rate: int) -> bytes:
        by = {c: np.concatenate([x for k, x in zip(channels, samples, strict=True) if k == c]) for c in dict.fromkeys(channels)}
        planes = np.zeros((max(map(len, by.values())), len(by)), "<f4")
        for i, x in enumerate(by.values()):
            planes[: len(x), i] = x
        return encode_wav(planes, rate)

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by recording, channel and start_frame. A recording is written when the next one begins, and files are handed on many at a time."""
        rec, parts, done, size = None, ([], []), [], 0
        rate = None
        for batch in it:
            flat, ends = batch["samples"].flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(batch["samples"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            for i, (name, first, channel, hz) in enumerate(zip(batch["rec"].to_pylist(), batch["first"].to_pylist(), batch["channel"].to_pylist(), batch["sample_rate"].to_pylist(), strict=True)):
                if first and parts[0]:
                    done.append({"rec": rec, "content": content(*parts, rate)})
                    size += len(done[-1]["content"])
                    parts = ([], [])
                    if len(done) >= ROWS or size >= 4 * SAMPLES:
                        yield pa.RecordBatch.from_pylist(done, schema=form)
                        done, size = [], 0
                if not parts[0]:
                    rec, rate = name, hz
                parts[0].append(channel)
                parts[1].append(flat[ends[i] : ends[i + 1]].astype("<f4"))
        if parts[0]:
            done.append({"rec": rec, "content": content(*parts, rate)})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=form)

    order = Window.partitionBy("rec").orderBy("channel", "start_frame")
    x = signals.where("status = 'ok' AND n_frames > 0 AND channel IS NOT NULL").select("rec", "channel", "sample_rate", "start_frame", "samples", (F.row_number().over(order) == 1).alias("first"))
    return x.select("rec", "channel", F.col("sample_rate").cast("int"), "samples", "first").mapInArrow(make, schema)


def write_wav(signals: DataFrame, path: str) -> None:
    to_wav(signals).write.mode("overwrite").parquet(path)


def synth_signals(spark: SparkSession, spec: DataFrame, block: int = 48_000) -> DataFrame:
    """rec, block_idx, start_frame, samples from rec, kind (silence, sine, noise, harmonic), hz, seconds, rate, seed; none for a bad duration.

    harmonic is pseudo-speech: harmonics of 110 Hz to 0.45 of the rate with amplitudes 1/h and phases h, under an envelope of
    3.5 syllables a second, with a little noise, clamped. Noise is a seeded xorshift sequence (functions.noise) whose state
    jumps to a block's start, so every block size gives the same signal; a null seed is the generator's own. `amplitude`, 0.5
    where it is null or missing, is that of sine and noise. Where spec has `channels`, so has the result, and a channel is 13
    frames behind the one before it.
    """
    many = "channels" in spec.columns
    good = spec.where("NOT isnan(seconds) AND seconds > 0 AND seconds < 1e9").withColumns({"n": F.floor(F.col("seconds") * F.col("rate")), "amplitude": F.coalesce(F.col("amplitude") if "amplitude" in spec.columns else F.lit(None), F.lit(0.5)).cast("double")})
    plan = good.where("n > 0").withColumn("block_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    plan = plan.withColumn("channel", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("channels").cast("int")) - 1)) if many else F.lit(0))

    def frames(r, start: int, end: int) -> np.ndarray:
        t, seed = np.arange(start, end) / r.rate, None if pd.isna(r.seed) else int(r.seed)
        if r.kind == "sine":
            return r.amplitude * np.sin(2 * np.pi * r.hz * t)
        if r.kind == "noise":
            return r.amplitude * noise(seed, start, end - start)
        if r.kind == "harmonic":
            x = np.zeros(end - start)
            for h in range(1, max(1, int(r.rate * 0.45 / 110)) + 1):
                x += np.sin(2 * np.pi * 110 * h * t + h) / h
            x = x / 3 * (0.35 + 0.65 * np.abs(np.sin(2 * np.pi * 3.5 * t))) + 0.01 * noise(seed, start, end - start)
            return np.clip(0.5 * x, -1, 1)
        return np.zeros(end - start)

    def make(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                a, b, behind = r.block_idx * block, min(r.n, (r.block_idx + 1) * block), r.channel * CHANNEL_DELAY
                begin = max(0, a - behind)
                out.append(np.concatenate([np.zeros(min(b, max(a, behind)) - a), frames(r, begin, max(begin, b - behind))]))
            yield pd.DataFrame({"rec": pdf["rec"], **({"channel": pdf["channel"]} if many else {}), "block_idx": pdf["block_idx"], "start_frame": pdf["block_idx"] * block, "samples": out})

    return plan.repartition("rec", "block_idx").mapInPandas(make, f"rec long, {'channel int, ' if many else ''}block_idx long, start_frame long, samples array<double>")
