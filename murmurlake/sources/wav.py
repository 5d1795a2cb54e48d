"""WAV files as a Spark data source: read by byte range, written as files of their own.

Reading lists files and cuts them into ranges of SPLIT bytes; a range is a task, or a part of one where files are small. Each task
reads the file's header and the blocks that begin in its range, so a file of any length is spread over tasks, and none holds more
than a block. Writing deals blocks by recording and order: a task streams them into a file under a temporary name, a block in
memory, and sets the sizes in the header at the end. The driver gives files their names once all tasks are done; of what failed or
ran twice nothing stays.

Paths are those of pyarrow.fs: local or shared folders, or a URI of a store it knows. What can't be read is a row whose status
says why, as in audio.decode_files.
"""

from __future__ import annotations

import io
import struct
import urllib.parse
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of files that a task reads at least, if there are so many.
SPLIT = 64 << 20
#: Tasks that a smaller split makes at most, as long as none has over SPLIT bytes.
TASKS = 1000
#: Blocks and samples that are handed to Spark, or to a file, at a time, if there are so many.
ROWS, SAMPLES = 1000, 1 << 16
BLOCK_FRAMES = 48_000
SIGNALS = "rec string, channel int, sample_rate int, block_idx long, start_frame long, n_frames int, samples array<float>, status string"
ARROW = pa.schema([("rec", pa.string()), ("channel", pa.int32()), ("sample_rate", pa.int32()), ("block_idx", pa.int64()), ("start_frame", pa.int64()), ("n_frames", pa.int32()), ("samples", pa.list_(pa.float32())), ("status", pa.string())])
#: (format tag, bits of a sample) -> numpy type and what a sample is divided by.
ENCODINGS = {(1, 16): ("<i2", 32768.0), (3, 32): ("<f4", 1.0)}
_EXTENSIBLE = 0xFFFE
#: A size that its writer didn't know, or that stands in a ds64 chunk.
_UNKNOWN = 0xFFFFFFFF


@dataclass
class Format:
    rate: int
    channels: int
    kind: str
    full: float
    at: int  # where samples begin
    size: int  # their bytes

    @property
    def frame_bytes(self) -> int:
        return np.dtype(self.kind).itemsize * self.channels

    @property
    def frames(self) -> int:
        return self.size // self.frame_bytes

    def decode(self, data: bytes) -> np.ndarray:
        """Frames x channels of whole frames."""
        x = np.frombuffer(data, self.kind, len(data) // self.frame_bytes * self.channels)
        return (x / self.full).astype(np.float32).reshape(-1, self.channels)


def read_format(read: Callable[[int, int], bytes], size: int) -> Format:
    """Format of a RIFF or RF64 file of `size` bytes from its chunks, which start at even places; ValueError if it is another."""
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data, wide = 12, b"", None, None
    while at + 8 <= size and len(chunk := read(at, 8)) == 8:
        name, n = struct.unpack("<4sI", chunk)
        if name == b"ds64":
            wide = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt ":
            fmt = read(at + 8, min(n, 40))
        elif name == b"data":
            if n == _UNKNOWN:
                n = wide if wide is not None else size - at - 8
            data = (at + 8, min(n, size - at - 8))
        at += 8 + n + (n & 1)
    if len(fmt) < 16 or data is None:
        raise ValueError("no format or no data")
    tag, channels, rate, bits = struct.unpack("<HHI6xH", fmt[:16])
    if tag == _EXTENSIBLE and len(fmt) >= 26:
        (tag,) = struct.unpack_from("<H", fmt, 24)
    if not channels or not rate:
        raise ValueError("no channels or no rate")
    if (tag, bits) not in ENCODINGS:
        raise ValueError("neither PCM16 nor float32")
    return Format(rate, channels, *ENCODINGS[tag, bits], *data)


def header(rate: int, channels: int, size: int) -> bytes:
    """Of a float32 file with so many bytes of samples. Over 4 GB the file is RF64; both headers are 80 bytes."""
    wide = size + 72 > _UNKNOWN
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, channels, rate, rate * channels * 4, channels * 4, 32)
    sizes = struct.pack("<4sIQQQI", b"ds64" if wide else b"JUNK", 28, *((size + 72, size, size // (4 * channels)) if wide else (0, 0, 0)), 0)
    return struct.pack("<4sI4s", b"RF64" if wide else b"RIFF", _UNKNOWN if wide else size + 72, b"WAVE") + sizes + fmt + struct.pack("<4sI", b"data", _UNKNOWN if wide else size)


@dataclass
class Ranges(InputPartition):
    """(path, size of the file, first byte, byte behind the last)."""

    parts: list[tuple[str, int, int, int]]


def ranges(files: list[tuple[str, int]], split: int, tasks: int = TASKS) -> list[Ranges]:
    """Files cut into ranges of `split` bytes; a task has as many of them as fit into `split`, or into more where there would be over `tasks`, up to SPLIT."""
    most = max(split, min(SPLIT, -(-sum(max(n, 1) for _, n in files) // tasks)))
    out: list[Ranges] = []
    held, total = [], 0
    for path, size in files:
        for a in range(0, max(size, 1), split):
            b = min(size, a + split)
            if total and total + b - a > most:
                out.append(Ranges(held))
                held, total = [], 0
            if held and a and held[-1][0] == path:
                held[-1] = (path, size, held[-1][2], b)
            else:
                held.append((path, size, a, b))
            total += b - a
    return [*out, Ranges(held)] if held else out


class WavReader(DataSourceReader):
    def __init__(self, path: str, block_frames: int, split: int):
        self.path, self.block_frames, self.split = path, block_frames, split

    def partitions(self) -> list[InputPartition]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.lower().endswith(".wav") and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/")))
        return ranges(files, self.split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        rows, samples = [], 0
        for path, size, a, b in partition.parts:
            with fs.open_input_file(path) as f:
                for row in self.rows(f, path, size, a, b):
                    rows.append(row)
                    samples += row.get("n_frames", 0)
                    if len(rows) >= ROWS or samples >= SAMPLES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, samples = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def rows(self, f: pa.NativeFile, path: str, size: int, a: int, b: int) -> Iterator[dict]:
        try:
            form = read_format(lambda at, n: f.read_at(n, at), size)
        except ValueError as why:
            if a == 0:
                yield {"rec": path, "status": str(why)}
            return
        step = self.block_frames * form.frame_bytes
        # A block is the range's that its first byte lies in; the first one is the first range's.
        k = max(1, -(-(a - form.at) // step)) if a else 0
        while k * self.block_frames < form.frames and (k == 0 or form.at + k * step < b):
            start = k * self.block_frames
            x = form.decode(f.read_at(min(step, (form.frames - start) * form.frame_bytes), form.at + k * step))
            yield from ({"rec": path, "channel": c, "sample_rate": form.rate, "block_idx": k, "start_frame": start, "n_frames": len(x), "samples": x[:, c], "status": "ok"} for c in range(form.channels))
            k += 1


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceArrowWriter):
    """Rows come by recording and start_frame, with the number of its channels and its rate."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _folder(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(self._folder(root), recursive=True)
        done, out = [], None
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or out.rec != r["rec"]:
                    if out:
                        done.append(out.close())
                    out = _File(fs, f"{self._folder(root)}/{uuid.uuid4().hex}", r["rec"], r["sample_rate"], r["channels"])
                out.add(r["channel"], r["start_frame"], np.asarray(r["samples"], "<f4"))
        if out:
            done.append(out.close())
        return Written([(tmp, f"{root}/{urllib.parse.quote(rec, safe='')}.wav") for tmp, rec in done])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and f.base_name.endswith(".wav"):
                    fs.delete_file(f.path)
        for tmp, name in (f for m in messages if m for f in m.files):
            fs.move(tmp, name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        if fs.get_file_info(self._folder(root)).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(self._folder(root))


class _File:
    """A file that grows by blocks; channels that have none at a place are silent there."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, rec: str, rate: int, channels: int):
        self.fs, self.path, self.rec, self.rate, self.channels = fs, path, rec, rate, channels
        self.at, self.held = 0, np.zeros((0, channels), "<f4")
        self.few, self.body = io.BytesIO(), None

    def add(self, channel: int, start: int, x: np.ndarray) -> None:
        # Blocks come by start_frame, so what lies before this one is complete.
        if start > self.at:
            self._out(start - self.at)
        begin = start - self.at
        if begin + len(x) > len(self.held):
            self.held = np.pad(self.held, ((0, begin + len(x) - len(self.held)), (0, 0)))
        self.held[begin : begin + len(x), channel] = x

    def _out(self, n: int) -> None:
        self._write(np.ascontiguousarray(self.held[:n]).tobytes())
        silent = n - len(self.held[:n])
        while silent > 0:
            self._write(bytes(4 * self.channels * min(silent, BLOCK_FRAMES)))
            silent -= BLOCK_FRAMES
        self.held, self.at = self.held[n:], self.at + n

    def _write(self, data: bytes) -> None:
        if self.body is None and self.few.tell() + len(data) > 4 * SAMPLES:
            self.body = self.fs.open_output_stream(f"{self.path}.body")
            self.body.write(self.few.getvalue())
        (self.few if self.body is None else self.body).write(data)

    def close(self) -> tuple[str, str]:
        """Stores can't write into what they have, so the header goes before a copy of the body, which is in memory where it is short."""
        self._out(len(self.held))
        with self.fs.open_output_stream(self.path) as f:
            f.write(header(self.rate, self.channels, self.at * self.channels * 4))
            if self.body is None:
                f.write(self.few.getvalue())
                return self.path, self.rec
            self.body.close()
            with self.fs.open_input_stream(f"{self.path}.body") as body:
                while data := body.read(8 << 20):
                    f.write(data)
        self.fs.delete_file(f"{self.path}.body")
        return self.path, self.rec


class WavSource(DataSource):
    """spark.read.format("wav").load(path), with options block_frames and split; and df.write.format("wav")."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SIGNALS

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("block_frames", BLOCK_FRAMES)), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options["path"], overwrite)


def read_wav(spark: SparkSession, path: str, block_frames: int = BLOCK_FRAMES, split: int = SPLIT) -> DataFrame:
    """SIGNALS of the .wav files under path, by ranges of bytes."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("block_frames", block_frames).option("split", split).load(path)


def write_wav(signals: DataFrame, path: str, mode: str = "append") -> None:
    """A .wav file (float32) for each recording with frames, under path; its name is rec, quoted. overwrite takes away those that are there."""
    signals.sparkSession.dataSource.register(WavSource)
    x = signals.where("status = 'ok' AND n_frames > 0").select(F.col("rec").cast("string"), F.col("channel").cast("int"), "sample_rate", F.col("start_frame").cast("long"), F.col("samples").cast("array<float>"))
    forms = x.groupBy("rec").agg((F.max("channel") + 1).alias("channels"), F.max("sample_rate").cast("int").alias("sample_rate"))
    dealt = x.drop("sample_rate").join(forms, "rec").repartition("rec").sortWithinPartitions("rec", "start_frame", "channel")
    dealt.select("rec", "channel", "channels", "sample_rate", "start_frame", "samples").write.format("wav").mode(mode).save(path)
