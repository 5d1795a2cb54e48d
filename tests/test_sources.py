"""Seekable noise, and WAV files by byte range."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from murmurlake.functions import noise
from murmurlake.sources import audio, wav


def sequential(seed, n):
    x, mask, out = noise.first_state(seed), (1 << 64) - 1, []
    for _ in range(n):
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        out.append(x % 2_000_003 / 1_000_001.5 - 1.0)
    return np.array(out)


@pytest.mark.parametrize("seed", [None, 0, 1, -5, noise.SEED])
def test_noise_starts_anywhere(seed):
    want = sequential(seed, 3000)
    for start, n in ((0, 3000), (0, 0), (0, 1), (1, 1), (777, 500), (2999, 1), (64, 2936)):
        assert (noise.noise(seed, start, n) == want[start : start + n]).all()
    assert len(noise.noise(seed, 10**13, 100)) == 100


def test_harmonic_mix_whatever_the_block(spark):
    """The whole signal, frame by frame, for blocks of any size; a second channel is 13 frames behind."""
    n, rate = 700, 2000
    hiss = sequential(None, n)
    want = []
    for i in range(n):
        t = i / rate
        v = sum(np.sin(2 * np.pi * 110 * h * t + h) / h for h in range(1, 9))
        want.append(max(-1, min(1, 0.5 * (v / 3 * (0.35 + 0.65 * abs(np.sin(2 * np.pi * 3.5 * t))) + 0.01 * hiss[i]))))
    spec = spark.createDataFrame([(1, "harmonic", 0.0, n / rate, rate, None, 2)], "rec long, kind string, hz double, seconds double, rate int, seed long, channels int")
    for block in (1000, 64, 7):
        rows = audio.synth_signals(spark, spec, block).orderBy("channel", "start_frame").collect()
        by = [np.concatenate([r.samples for r in rows if r.channel == c]) for c in (0, 1)]
        assert np.allclose(by[0], want, atol=1e-9) and np.allclose(by[1], [0.0] * 13 + want[:-13], atol=1e-9)


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.rec, r.channel or 0, r.start_frame or 0)):
        out.setdefault(os.path.basename(r.rec), {}).setdefault(r.channel, []).append(r)
    return out


@pytest.mark.parametrize("split", [1, 37, 1000, 10**9])
def test_ranges_give_every_block_once(spark, tmp_path, split):
    rng = np.random.default_rng(1)
    x = {f"{n}.wav": rng.normal(size=(n, 1 + n % 3)).astype(np.float32) for n in (1, 7, 64, 301)}
    for name, s in x.items():
        (tmp_path / name).write_bytes(audio.encode_wav(s, 8000))
    odd = struct.pack("<4sI4s4sI3sx4sIHHIIHH4sI", b"RIFF", 80, b"WAVE", b"note", 3, b"abc", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16, b"data", 0xFFFFFFFF) + struct.pack("<5h", 0, 16384, -16384, 32767, -32768)
    (tmp_path / "odd.wav").write_bytes(odd)
    (tmp_path / "bad.wav").write_bytes(b"RIFF1234nope" + bytes(200))
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "_hidden.wav").write_bytes(b"x")
    (tmp_path / "other.txt").write_bytes(b"x")
    if split < 1000:  # a task for each range would be thousands
        reader = wav.WavReader(str(tmp_path), 16, split)
        rows = [Row(**r) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    else:
        rows = wav.read_wav(spark, str(tmp_path), 16, split).collect()
    got = whole(rows)
    assert {k for k, v in got.items() if None in v} == {"bad.wav", "empty.wav"}
    assert got["bad.wav"][None][0].status == "not a WAV file" and len(got["bad.wav"][None]) == 1
    for name, s in x.items():
        assert sorted(got[name]) == list(range(s.shape[1]))
        for c, blocks in got[name].items():
            assert [b.block_idx for b in blocks] == list(range(-(-len(s) // 16))) and all(b.start_frame == 16 * b.block_idx and b.n_frames == len(b.samples) for b in blocks)
            assert np.array_equal(np.concatenate([b.samples for b in blocks]).astype(np.float32), s[:, c])
    assert np.allclose(got["odd.wav"][0][0].samples, [0, 0.5, -0.5, 32767 / 32768, -1])


def test_a_file_over_two_gigabytes_is_many_ranges(tmp_path):
    """3 GB (a sparse file) are 48 ranges; each finds its own blocks, and none is read twice."""
    size = 3 << 30
    path = tmp_path / "long.wav"
    with open(path, "wb") as f:
        f.write(wav.header(48_000, 2, size))
        f.truncate(80 + size)
    reader = wav.WavReader(str(path), 48_000, wav.SPLIT)
    parts = reader.partitions()
    assert len(parts) == 49 and all(len(p.parts) == 1 for p in parts[:-1])
    found = [b["block_idx"][0].as_py() for p in (parts[0], parts[1], parts[24], parts[47], parts[48]) for b in reader.read(p)]
    assert len(found) == len(set(found)) and found[0] == 0 and found[-1] == size // 8 // 48_000
    data = {0: wav.header(8000, 1, 5 << 30)}
    form = wav.read_format(lambda at, n: data[0][at : at + n], (5 << 30) + 80)
    assert (form.at, form.size, form.rate, form.channels) == (80, 5 << 30, 8000, 1)


def test_files_are_written_once(spark, tmp_path):
    """Uneven channels and gaps are silent; a second write adds or replaces; nothing but .wav files stays."""
    rows = [("a/b", 0, 8000, 0, 0, 4, [1.0, 2.0, 3.0, 4.0], "ok"), ("a/b", 0, 8000, 2, 8, 2, [5.0, 6.0], "ok"), ("a/b", 1, 8000, 0, 0, 4, [9.0] * 4, "ok"), ("c", 0, 16000, 0, 0, 1, [0.5], "ok"), ("bad", 0, 0, 0, 0, 0, [], "ok"), ("worse", None, None, None, None, None, None, "not a WAV file")]
    s = spark.createDataFrame(rows, wav.SIGNALS)
    to = str(tmp_path / "out")
    wav.write_wav(s, to)
    assert sorted(os.listdir(to)) == ["a%2Fb.wav", "c.wav"]
    rate, x = audio.decode_wav((tmp_path / "out" / "a%2Fb.wav").read_bytes())
    assert rate == 8000 and x.tolist() == [[1, 9], [2, 9], [3, 9], [4, 9], [0, 0], [0, 0], [0, 0], [0, 0], [5, 0], [6, 0]]
    wav.write_wav(s.where("rec = 'c'").withColumn("rec", F.lit("d")), to)
    assert sorted(os.listdir(to)) == ["a%2Fb.wav", "c.wav", "d.wav"]
    wav.write_wav(s.where("rec = 'c'"), to, "overwrite")
    assert os.listdir(to) == ["c.wav"]


def test_what_a_failed_write_leaves(tmp_path):
    w = wav.WavWriter(str(tmp_path), False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"rec": "x", "channel": 0, "channels": 1, "sample_rate": 8, "start_frame": 0, "samples": [1.0]}])
    w.write(iter([batch]))
    w.write(iter([batch]))  # a second attempt of the same task
    w.abort([])
    assert os.listdir(tmp_path) == []


def test_small_ranges_share_tasks():
    """5,000 files of two ranges: at most about 1,000 tasks, which hold every byte once; large ranges stay tasks of their own."""
    from murmurlake.sources.wav import SPLIT, TASKS, ranges

    got = ranges([(f"f{i}", 900) for i in range(5000)], 500)
    assert len(got) <= TASKS * 1.2
    assert sum(b - a for r in got for _, _, a, b in r.parts) == 5000 * 900
    assert len(ranges([("f", 5 * SPLIT)], SPLIT)) == 5


def test_many_files_are_few_batches(tmp_path):
    from murmurlake.sources import wav as w

    for i in range(300):
        (tmp_path / f"{i}.wav").write_bytes(w.header(8000, 1, 400) + np.arange(100, dtype="<f4").tobytes())
    batches = [b for p in w.WavReader(str(tmp_path), 10, 500).partitions() for b in [*w.WavReader(str(tmp_path), 10, 500).read(p)]]
    assert sum(len(b) for b in batches) == 3000 and len(batches) <= 302
    one = [*w.WavReader(str(tmp_path), 10, w.SPLIT).read(w.WavReader(str(tmp_path), 10, w.SPLIT).partitions()[0])]
    assert [len(b) for b in one] == [1000, 1000, 1000]
