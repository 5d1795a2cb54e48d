"""Spectral features by block: frames are computed where their samples lie, with a halo from the neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signals import keys, schema_of, with_halo

#: Samples that istft adds up at once.
AT_ONCE = 1 << 18
WINDOWS = {"hann": lambda n: 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n), "hamming": np.hamming, "blackman": np.blackman, "bartlett": np.bartlett, "povey": lambda n: np.hanning(n) ** 0.85}


def window_of(window: str | Sequence[float], size: int) -> np.ndarray:
    """A window by name or as it is, with zeros behind it where it is shorter."""
    w = WINDOWS[window](size) if isinstance(window, str) else np.asarray(window, float)
    return np.pad(w, (0, max(0, size - len(w))))[:size]


def mel_filters(rate: int, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None, scale: str = "slaney", norm: str | None = "scale") -> np.ndarray:
    """n_mels x bins triangles. scale: slaney, which is linear under 1 kHz, or htk, logarithmic. norm: slaney, of equal area; None, of height 1; or the one that goes with the scale."""
    norm = ("slaney" if scale == "slaney" else None) if norm == "scale" else norm
    high = high or rate / 2
    if scale == "htk":
        to, back = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    else:
        step = np.log(6.4) / 27
        to = lambda f: np.where(np.asarray(f) < 1000, np.asarray(f) * 3 / 200, 15 + np.log(np.maximum(np.asarray(f), 1e-9) / 1000) / step)
        back = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))
    hz = back(np.linspace(to(low), to(high), n_mels + 2))
    f = np.linspace(0, rate // 2, n_fft // 2 + 1)
    up, down = (f - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - f) / np.diff(hz)[1:, None]
    w = np.maximum(0, np.minimum(up, down))
    return w if norm is None else w * (2 / (hz[2:] - hz[:-2]))[:, None]


def framewise(signals: DataFrame, n_fft: int, hop: int, fn, pad: str = "reflect", size: int = 48_000, center: bool = True) -> DataFrame:
    """By signal, frame, bins: fn (frames x n_fft -> frames x bins) at every hop, centred, with the ends reflected or zero; or, not centred, of whole frames that start there."""
    size = -(-size // hop) * hop
    half, own = n_fft // 2 if center else 0, keys(signals)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames of many short signals are handed on together."""
        held, many = [], 0
        for part in (p for pdf in it for p in each(pdf)):
            held.append(part)
            many += part[1].size
            if many >= AT_ONCE or len(held) >= 1000:
                yield together(held)
                held, many = [], 0
        if held:
            yield together(held)

    def together(held: list) -> pd.DataFrame:
        n = [len(bins) for _, bins in held]
        frame = np.concatenate([r.start_frame // hop + np.arange(k) for (r, _), k in zip(held, n, strict=True)])
        named = {k: pd.Series([getattr(r, k) for r, _ in held]).repeat(n).reset_index(drop=True) for k in own}
        return pd.DataFrame({**named, "frame": frame, "bins": [b for _, bins in held for b in bins]})

    def each(pdf: pd.DataFrame) -> Iterator[tuple]:
        for r in pdf.itertuples():
            x, lead = np.asarray(r.samples, float), r.lead
            if not center:
                x = x[lead:]
                n = min(-(-r.n // hop), (len(x) - n_fft) // hop + 1)
                if n < 1:
                    continue
                frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop][:n]
            else:
                # A signal of no more than half a window has nothing to be reflected.
                mirrored = pad == "reflect" and len(x) > half
                if r.start_frame == 0:
                    x = np.concatenate([x[1 : half + 1][::-1] if mirrored else np.zeros(half), x])
                    lead = half
                at_end = not r.trail
                n = r.n // hop + 1 if at_end else -(-r.n // hop)
                need = lead + (n - 1) * hop + half + n_fft % 2
                if need > len(x):
                    more = need - len(x)
                    x = np.concatenate([x, x[-2 : -2 - more : -1] if mirrored else np.zeros(more)])
                first = lead - half
                frames = np.lib.stride_tricks.sliding_window_view(x[max(0, first) :], n_fft)[::hop][:n]
            yield r, fn(frames)

    return with_halo(signals, half, half + n_fft % 2 if center else n_fft, size).mapInPandas(run, schema_of(signals, own, "frame long, bins array<double>"))


def stft(signals: DataFrame, n_fft: int = 400, hop: int = 160, window: str | Sequence[float] = "hann", pad: str = "reflect", size: int = 48_000, center: bool = True, win_length: int | None = None) -> DataFrame:
    """By signal, frame, bins: real parts, then imaginary ones. A window of win_length samples has zeros behind it."""
    w = np.pad(window_of(window, min(win_length or n_fft, n_fft)), (0, n_fft - min(win_length or n_fft, n_fft)))

    def fn(frames):
        z = np.fft.rfft(frames * w)
        return np.concatenate([z.real, z.imag], axis=1)

    return framewise(signals, n_fft, hop, fn, pad, size, center)


def istft(spectra: DataFrame, total: DataFrame, n_fft: int = 400, hop: int = 160, window: str | Sequence[float] = "hann", block: int = 64, norm: str = "squares", center: bool = True) -> DataFrame:
    """Signals of stft's rows. total: rec, n (lengths() of the signals), or n_frames(spectra) for what the frames alone reach.

    norm: squares divides by the windows' summed squares, which undoes stft. sum divides by the summed windows, a fixed rule of
    other tools: their named window is one sample longer and loses its last. Where the sum is 0 samples stay as they are.
    """
    w = window_of(window, n_fft) if norm == "squares" or not isinstance(window, str) else window_of(window, n_fft + 1)[:n_fft]
    own_keys, early = keys(spectra, total), n_fft // 2 if center else 0
    reach = -(-n_fft // (hop * block)) + 1

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        """Many blocks at once: their frames are one array, and so are the samples they add up to."""
        at, bins = (np.concatenate([np.asarray(x, kind) for x in pdf[c]]) for c, kind in (("frames", np.int64), ("bins", float)))
        lo = pdf["to"].to_numpy() * block * hop
        size = np.minimum(lo + block * hop, pdf["n"].to_numpy()) - lo
        ends = np.cumsum(size + 2 * n_fft)
        row = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["frames"]])
        # A block's samples stand between n_fft others on either side, which frames reach that it shares.
        place = (at * hop - early - lo[row] + n_fft + (ends - size - 2 * n_fft)[row])[:, None] + np.arange(n_fft)
        z = bins.reshape(len(at), -1) if len(at) else np.zeros((0, n_fft // 2 * 2 + 2))
        z = z[:, : z.shape[1] // 2] + 1j * z[:, z.shape[1] // 2 :]
        out = np.bincount(place.ravel(), (np.fft.irfft(z, n_fft) * w).ravel(), ends[-1])
        by = np.bincount(place.ravel(), np.tile(w**2 if norm == "squares" else w, len(at)), ends[-1])
        x = np.divide(out, by, out=np.zeros_like(out) if norm == "squares" else out.copy(), where=by > 1e-10 if norm == "squares" else by != 0)
        samples = [x[e - n_fft - k : e - n_fft] for e, k in zip(ends, size, strict=True)]
        return pd.DataFrame({**{k: pdf[k] for k in own_keys}, "block_idx": pdf["to"], "start_frame": lo, "samples": samples})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = max(1, AT_ONCE // (block * hop + 2 * n_fft))
        for pdf in it:
            for k in range(0, len(pdf), many):
                yield blocks(pdf.iloc[k : k + many].reset_index(drop=True))

    own = F.floor(F.col("frame") / block)
    x = spectra.withColumn("to", F.explode(F.sequence(F.greatest(F.lit(0), own - reach), own + reach))).join(total, own_keys).where(F.col("to") * block * hop < F.col("n"))
    # A frame goes to the blocks it has samples in; to its other neighbours only the word that they are there.
    first = F.col("frame") * hop - early - F.col("to") * block * hop
    there = (first > -n_fft) & (first < F.least(F.lit(block * hop), F.col("n") - F.col("to") * block * hop))
    x = x.groupBy(*own_keys, "to").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(there, F.struct("frame", "bins")))).alias("all"))
    x = x.select(*own_keys, "to", F.col("n").cast("long"), F.transform("all", lambda f: f["frame"]).alias("frames"), F.flatten(F.transform("all", lambda f: f["bins"])).alias("bins"))
    return x.mapInPandas(run, schema_of(spectra, own_keys, "block_idx long, start_frame long, samples array<double>"))


def n_frames(spectra: DataFrame, n_fft: int = 400, hop: int = 160, center: bool = True) -> DataFrame:
    """By signal, n: the samples that frames reach, less half a frame at either end where they are centred."""
    return spectra.groupBy(*keys(spectra)).agg((F.max("frame") * hop + n_fft - (n_fft // 2 * 2 if center else 0)).alias("n"))


def mel(signals: DataFrame, rate: int, n_fft: int = 400, hop: int = 160, n_mels: int = 80, scale: str = "slaney", power: float = 2.0, norm: str | None = "scale") -> DataFrame:
    w, m = WINDOWS["hann"](n_fft), mel_filters(rate, n_fft, n_mels, scale=scale, norm=norm)
    return framewise(signals, n_fft, hop, lambda f: np.abs(np.fft.rfft(f * w)) ** power @ m.T)


def log_mel(signals: DataFrame, rate: int = 16000, n_mels: int = 128) -> DataFrame:
    """Two passes: log10 with a floor of 1e-10, then at least the recording's maximum - 8, scaled by (x + 4) / 4."""
    x = mel(signals, rate, n_mels=n_mels).withColumn("bins", F.transform("bins", lambda v: F.log10(F.greatest(v, F.lit(1e-10)))))
    own = keys(x)
    top = x.groupBy(*own).agg(F.max(F.array_max("bins")).alias("top"))
    return x.join(top, own).select(*own, "frame", F.transform("bins", lambda v: (F.greatest(v, F.col("top") - 8) + 4) / 4).alias("bins"))


def kaldi_fbank(signals: DataFrame, rate: int = 16000, n_mels: int = 80, frame_ms: int = 25, hop_ms: int = 10, preemphasis: float = 0.97, snip_edges: bool = True) -> DataFrame:
    """Log mel energies of frames without their mean, pre-emphasised, under a povey window.

    With snip_edges whole frames only; else as many as there are hops (rounded), whose frames lie centred over mirrored ends, or
    over silence where a signal is no longer than what would be mirrored; frames must then be as long as hops at least.
    """
    n, hop = rate * frame_ms // 1000, rate * hop_ms // 1000
    n_fft = 1 << (n - 1).bit_length()
    w, m, own = WINDOWS["povey"](n), mel_filters(rate, n_fft, n_mels, 20.0, scale="htk"), keys(signals)
    early = 0 if snip_edges else n // 2 - hop // 2
    if early < 0:
        raise ValueError("frames are shorter than hops")
    size = 300 * hop

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                x = np.asarray(r.samples, float)
                if snip_edges:
                    x = x[r.lead :]
                    k = min(-(-r.n // hop), (len(x) - n) // hop + 1)
                else:
                    total = r.start_frame + r.n + r.trail  # the signal's end, where it is near
                    mirrored = total > early
                    if r.start_frame == 0:
                        x = np.concatenate([x[1 : early + 1][::-1] if mirrored else np.zeros(early), x])
                    lead = early if r.start_frame == 0 else r.lead
                    x = x[lead - early :]
                    k = (r.n + hop // 2) // hop if not r.trail else -(-r.n // hop)
                    if (more := (k - 1) * hop + n - len(x)) > 0:
                        x = np.concatenate([x, x[-2 : -2 - more : -1] if mirrored else np.zeros(more)])
                if k < 1:
                    continue
                f = np.lib.stride_tricks.sliding_window_view(x, n)[::hop][:k]
                f = f - f.mean(axis=1, keepdims=True)
                f = np.concatenate([f[:, :1] * (1 - preemphasis), f[:, 1:] - preemphasis * f[:, :-1]], axis=1) * w
                e = np.abs(np.fft.rfft(f, n_fft)) ** 2 @ m.T
                yield pd.DataFrame({**{c: getattr(r, c) for c in own}, "frame": r.start_frame // hop + np.arange(k), "bins": list(np.log(np.maximum(e, np.finfo(np.float32).eps)))})

    return with_halo(signals, early, n, size).mapInPandas(run, schema_of(signals, own, "frame long, bins array<double>"))


def with_deltas(features: DataFrame, reach: int = 2, shard: int = 10_000) -> DataFrame:
    """bins, then their regression slopes over +/- reach frames (ends repeated), then those of the slopes.

    Frames are dealt to shards with the 2 * reach frames before and after, so no recording is sorted in one task.
    """
    own, shard = keys(features), max(shard, 2 * reach)
    x = features.withColumn("shard", F.explode(F.array_distinct(F.array(*[F.floor((F.col("frame") + d) / shard) for d in (-2 * reach, 0, 2 * reach)]))))
    scale = 2 * sum(k * k for k in range(1, reach + 1))

    def slopes(m: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        i = np.arange(len(m))
        return sum(k * (m[np.minimum(i + k, last)] - m[np.maximum(i - k, first)]) for k in range(1, reach + 1)) / scale

    def shards(pdf: pd.DataFrame) -> np.ndarray:
        """The place of each shard's first row."""
        codes = np.stack([pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in [*own, "shard"]])
        return np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])

    def whole(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, part in pdf.groupby(pdf["bins"].map(len), sort=False):
            m, begin = np.array(part["bins"].tolist(), float), shards(part)
            size = np.diff(np.r_[begin, len(part)])
            first, last = np.repeat(begin, size), np.repeat(begin + size - 1, size)
            # Edges of a shard that are no ends of the signal come out wrong within 2 * reach, and aren't its own.
            d1 = slopes(m, first, last)
            mine = (part["frame"] // shard == part["shard"]).to_numpy()
            if mine.any():
                yield part.loc[mine, [*own, "frame"]].assign(bins=list(np.concatenate([m, d1, slopes(d1, first, last)], axis=1)[mine]))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Many shards at a time; the last one of a batch waits for its rest."""
        held = []
        for pdf in it:
            if not len(pdf):
                continue
            both = pd.concat([*held, pdf], ignore_index=True)
            cut = shards(both)[-1]
            held = [both.iloc[cut:]]
            if cut:
                yield from whole(both.iloc[:cut])
        if held:
            yield from whole(held[0].reset_index(drop=True))

    dealt = x.select(*own, "shard", "frame", "bins").repartition(*own, "shard").sortWithinPartitions(*own, "shard", "frame")
    return dealt.mapInPandas(run, schema_of(features, own, "frame long, bins array<double>"))
