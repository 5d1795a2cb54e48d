"""Streams keyed by recording: speech events, incremental stitching, utterances, timelines, event counts.

What needs more than an aggregate is a StatefulProcessor. Its state is one recording's, in parts that are read and written by
themselves: the head (whose turn it is, what has been emitted, whether it has ended) is a value, what came before its turn is a
map by number, so that a chunk that waits costs one entry, not the whole. Rows are put in order across triggers; of what comes
early MOST_EARLY wait, then the gap before them is given up. What comes after its place was emitted is late: counted, not emitted
again.

A recording ends with its last chunk. Its head stays as a tombstone, so a replay after the end is late too. In a stream that runs
on, `idle` milliseconds without a row end it as well: what waits is emitted over its gaps, then the rest. Time is processing
time, or that of `event_time`, a column with a watermark: then the stream's own data end a recording, and rows later than the
watermark are Spark's to drop and to count. `keep` milliseconds after that the tombstone goes: by state TTL in processing time,
by a second timer in event time. A stream that is drained once takes no `idle`, and its tombstones stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.lineage import scratch
from ..operators.chunks import ChunkConfig
from ..operators.signals import schema_of

MOST_EARLY = 10_000
#: A day.
KEEP = 86_400_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Recording(StatefulProcessor):
    """Head, waiting rows and timers of a recording. HEAD starts with following, early, due, ended; FRESH is a recording's that is new."""

    HEAD = "following long, early long, due long, ended boolean"
    FRESH: tuple = (0, 0, -1, False)
    WAITING = "value double"

    def __init__(self, idle: int | None, event_time: str | None, keep: int):
        self.idle, self.event_time, self.keep = idle, event_time, keep

    @property
    def time_mode(self) -> str:
        return "None" if not self.idle else "EventTime" if self.event_time else "ProcessingTime"

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.keep if self.time_mode == "ProcessingTime" else None
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD, ttl)
        self.waiting = handle.getMapState("waiting", "number long", self.WAITING, ttl)

    def close(self) -> None:
        pass

    def begun(self) -> list:
        """The head; kept: whether there has been one before, as only then anything is kept beside it."""
        head = self.head.get()
        self.kept = head is not None
        return list(head or self.FRESH)

    def store(self, head: list, latest: int) -> None:
        """Write the head and set its timer anew. latest: the time of the row that came last, or now."""
        if self.idle:
            if head[2] >= 0:
                self.handle.deleteTimer(head[2])
            head[2] = latest + (self.keep if head[3] else self.idle)
            self.handle.registerTimer(head[2])
        self.head.update(tuple(head))

    def now(self, timers, frames: Iterable[pd.DataFrame]) -> int:
        if not self.event_time:
            return timers.getCurrentProcessingTimeInMs() if self.idle else 0
        return max((int(t.timestamp() * 1000) for x in frames if len(x) and not pd.isna(t := x[self.event_time].max())), default=timers.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        came = list(rows)
        head = self.begun()
        yield from self.take(key, head, came)
        self.store(head, self.now(timerValues, came))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        head = self.begun()
        head[2] = -1  # it has fired
        if head[3] or not self.head.exists():
            self.clear()
            return
        yield from self.give_up(key, head)
        self.waiting.clear()
        head[1] = 0
        self.store(head, expiredTimerInfo.getExpiryTimeInMs())

    def clear(self) -> None:
        self.head.clear()
        self.waiting.clear()

    def take(self, key, head: list, came: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def give_up(self, key, head: list) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


def _run(rows: DataFrame, processor: _Recording, columns: str, mode: str = "append") -> DataFrame:
    """The processor over rows keyed by rec. Its state needs RocksDB: a session with another provider is set to it."""
    spark = rows.sparkSession
    if "RocksDB" not in (spark.conf.get(_PROVIDER, None) or ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("rec").transformWithStateInPandas(processor, schema_of(rows, ["rec"], columns), mode, processor.time_mode)


#: Frames whose places share one entry of the state.
SPAN = 512


class _Speech(_Recording):
    """Frames that wait are SPAN places to an entry, so what a trigger reads and writes grows with the spans that it touches, not with frames."""

    HEAD = f"{_Recording.HEAD}, speaking boolean"
    FRESH = (*_Recording.FRESH, False)
    WAITING = "numbers binary, probs binary"

    def __init__(self, threshold: float, frame_ms: int, *how):
        super().__init__(*how)
        self.threshold, self.frame_ms = threshold, frame_ms

    def take(self, key, head, came):
        head[3] = False  # frames after a silence go on where it was
        number, prob = (np.concatenate([x[c].to_numpy() for x in came]) for c in ("frame", "prob"))
        was = self._waiting() if head[1] else {}
        held = [np.concatenate(x) for x in zip(*was.values(), strict=True)] if was else [np.zeros(0, np.int64), np.zeros(0)]
        number, prob = np.concatenate([held[0], number]).astype(np.int64), np.concatenate([held[1], prob])
        number, first = np.unique(number, return_index=True)
        prob = prob[first][number >= head[0]]
        number = number[number >= head[0]]
        # Consecutive frames from the one whose turn it is; all of them where too many wait for one that is lost.
        ready = int((number == head[0] + np.arange(len(number))).sum()) if len(number) <= MOST_EARLY else len(number)
        yield from self._events(key, head, number[:ready], prob[:ready])
        number, prob = number[ready:], prob[ready:]
        cuts = np.flatnonzero(np.diff(number // SPAN)) + 1
        now = {int(n[0]) // SPAN: (n, p) for n, p in zip(np.split(number, cuts), np.split(prob, cuts), strict=True) if len(n)}
        for k in was.keys() - now.keys():
            self.waiting.removeKey((k,))
        for k, (n, p) in now.items():
            if k not in was or not np.array_equal(n, was[k][0]):
                self.waiting.updateValue((k,), (n.tobytes(), p.tobytes()))
        head[1] = len(number)

    def give_up(self, key, head):
        waits = self._waiting() if head[1] else {}
        for k in sorted(waits):
            yield from self._events(key, head, *waits[k])
        head[3] = True

    def _waiting(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Numbers and probabilities by span, each in order."""
        return {k[0]: (np.frombuffer(v[0], np.int64), np.frombuffer(v[1], float)) for k, v in self.waiting.iterator()}

    def _events(self, key, head: list, number: np.ndarray, prob: np.ndarray) -> Iterator[pd.DataFrame]:
        hot = prob >= self.threshold
        at = np.flatnonzero(hot != np.append(head[4], hot[:-1])) if len(hot) else np.zeros(0, int)
        if len(hot):
            head[0], head[4] = int(number[-1]) + 1, bool(hot[-1])
        if len(at):
            yield pd.DataFrame({"rec": [key[0]] * len(at), "at_ms": (number[at] * self.frame_ms).astype(np.int64), "is_speech": hot[at]})


def speech_events(frames: DataFrame, threshold: float = 0.5, frame_ms: int = 256, idle: int | None = None, event_time: str | None = None, keep: int = KEEP) -> DataFrame:
    """rec, at_ms, is_speech: a row whenever speech starts or ends. frames: rec, frame (from 0), prob. A frame that comes twice counts once."""
    return _run(frames, _Speech(threshold, frame_ms, idle, event_time, keep), "at_ms long, is_speech boolean")


def weights(n: int, blend: str, config: ChunkConfig, first: bool, last: bool, flat: bool) -> np.ndarray:
    i = np.arange(n)
    if blend == "triangular":
        half = n // 2
        return np.where(i < half, (i + 1) / max(half, 1), (n - i) / max(half, 1)) if n > 1 else np.ones(n)
    w = np.sin(np.pi * i / (n - 1)) ** 2 if n > 1 else np.ones(n)
    if flat and first:
        w[: config.stride] = 1
    if flat and last:
        w[config.shared :] = 1
    return w


BLOCKS = "start_frame long, samples array<double>, late long"
#: Blocks of silence that are handed on at a time.
SILENT = 256


class _Stitch(_Recording):
    """Chunks in their order. at: frames emitted; total: the recording's length, as its chunks say."""

    HEAD = f"{_Recording.HEAD}, at long, total long"
    FRESH = (*_Recording.FRESH, 0, 0)
    WAITING = "start_frame long, total long, is_first boolean, is_last boolean, samples array<double>"

    def __init__(self, config: ChunkConfig, *how):
        super().__init__(*how)
        self.config = config

    def take(self, key, head, came):
        late, fresh, out, waited = 0, {}, [], head[1]
        for r in (r for x in came for r in x.itertuples()):
            n = int(r.chunk_idx)
            if head[3] or n < head[0] or n in fresh or (head[1] and self.waiting.containsKey((n,))):
                late += 1
            else:
                fresh[n] = (int(r.start_frame), int(r.total), bool(r.is_first), bool(r.is_last), np.asarray(r.samples, float))
        self.resume()
        for chunk in self._ready(head, fresh):
            out += self.add(head, *chunk)
            if chunk[3]:
                head[3] = True
                late += len(fresh)
                fresh = {}
                break
        for n, (start, total, first, last, x) in fresh.items():
            self.waiting.updateValue((n,), (start, total, first, last, x.tolist()))
        head[1] += len(fresh)
        if head[3]:
            if waited:
                self.waiting.clear()
            head[1] = 0
        self.hold(head)
        yield from self._blocks(key, out, late)

    def _ready(self, head: list, fresh: dict) -> Iterator[tuple]:
        while True:
            n = head[0]
            if n in fresh:
                chunk = fresh.pop(n)
            elif head[1] and self.waiting.containsKey((n,)):
                *what, samples = self.waiting.getValue((n,))
                chunk = (*what, np.asarray(samples, float))
                self.waiting.removeKey((n,))
                head[1] -= 1
            elif len(fresh) + head[1] > MOST_EARLY:
                head[0] = min([*fresh, *(k[0] for k in self.waiting.keys())])
                continue
            else:
                return
            head[0] = n + 1
            yield chunk

    def give_up(self, key, head):
        """What waits, over its gaps, what the window still holds, and silence to the recording's length."""
        self.resume()
        for n in sorted(k[0] for k in self.waiting.keys()):
            *what, samples = self.waiting.getValue((n,))
            head[0] = n + 1
            yield from self._blocks(key, self.add(head, *what, np.asarray(samples, float)), 0)
        yield from self._blocks(key, self.rest(head), 0)
        for a in range(head[4], head[5], SILENT * self.config.stride):
            starts = range(a, min(head[5], a + SILENT * self.config.stride), self.config.stride)
            yield from self._blocks(key, [(s, np.zeros(min(self.config.stride, head[5] - s))) for s in starts], 0)
        head[3], head[4] = True, max(head[4], head[5])
        self.hold(head)

    @staticmethod
    def _blocks(key, out: list[tuple[int, np.ndarray]], late: int) -> Iterator[pd.DataFrame]:
        """Blocks; the number of late chunks stands on the last, which is empty if there is no other."""
        out = out or ([(0, np.zeros(0))] if late else [])
        if out:
            yield pd.DataFrame({"rec": [key[0]] * len(out), "start_frame": [at for at, _ in out], "samples": [x for _, x in out], "late": [0] * (len(out) - 1) + [late]})

    def resume(self) -> None:
        """Read what is kept beside the head."""

    def hold(self, head: list) -> None:
        """Write it."""

    def add(self, head: list, start: int, total: int, first: bool, last: bool, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        raise NotImplementedError

    def rest(self, head: list) -> list[tuple[int, np.ndarray]]:
        return []


class _OverlapAdd(_Stitch):
    """After a chunk that starts at s frames below s + stride are final; the window holds the sums and weights behind them."""

    def __init__(self, config: ChunkConfig, blend: str, flat: bool, *how):
        super().__init__(config, *how)
        self.blend, self.flat = blend, flat

    def init(self, handle):
        super().init(handle)
        self.window = handle.getValueState("window", "sums binary, norm binary", self.keep if self.time_mode == "ProcessingTime" else None)

    def resume(self):
        self.sums, self.norm = (np.frombuffer(b, float).copy() for b in (self.window.get() if self.kept else None) or (b"", b""))

    def hold(self, head):
        if head[3] and self.kept:
            self.window.clear()
        elif not head[3]:
            self.window.update((self.sums.tobytes(), self.norm.tobytes()))

    def clear(self):
        super().clear()
        self.window.clear()

    def add(self, head, start, total, first, last, x):
        at = head[4]
        w = weights(len(x), self.blend, self.config, first, last, self.flat)
        n = max(len(self.sums), start + len(x) - at)
        self.sums, self.norm = (np.pad(v, (0, n - len(v))) for v in (self.sums, self.norm))
        self.sums[start - at : start - at + len(x)] += x * w
        self.norm[start - at : start - at + len(x)] += w
        head[5] = total
        return self._emit(head, min(total, at + n) if last else min(total, start + self.config.stride))

    def rest(self, head):
        return self._emit(head, min(head[5], head[4] + len(self.sums)))

    def _emit(self, head, until):
        at, k = head[4], until - head[4]
        if k <= 0:
            return []
        out = np.divide(self.sums[:k], self.norm[:k], out=np.zeros(k), where=self.norm[:k] > 1e-8)
        self.sums, self.norm, head[4] = self.sums[k:], self.norm[k:], until
        return [(at, out)]


class _Discard(_Stitch):
    """Half the overlap is given up at every edge but the first chunk's head; silence where no chunk is."""

    def add(self, head, start, total, first, last, x):
        up, c = self.config.shared // 2, self.config
        begin = 0 if first else up
        kept = x[begin : max(begin, min(c.chunk - up if last else c.stride + up, len(x), total - start))]
        at, head[5] = start + begin, total
        out = [(head[4], np.zeros(at - head[4]))] if at > head[4] and head[4] < total else []
        if last:
            kept = np.pad(kept, (0, max(0, total - at - len(kept))))
        # Frames that the chunk before has given are the later chunk's in a batch; a stream has emitted them.
        kept, at = kept[max(0, head[4] - at) :], max(at, head[4])
        if len(kept):
            out.append((at, kept))
        head[4] = max(head[4], at + len(kept))
        return out


def stitch_stream(chunks: DataFrame, config: ChunkConfig, blend: str = "triangular", flat: bool = True, idle: int | None = None, event_time: str | None = None, keep: int = KEEP) -> DataFrame:
    """rec, BLOCKS: overlap-add chunk by chunk, equal to the batch stitch.

    chunks: rec, chunk_idx, start_frame, total, is_first, is_last, samples. Where chunks are lost or stop early, frames that
    others cover are those of a batch without the lost ones, and all others up to total are silent.
    """
    return _run(chunks, _OverlapAdd(config, blend, flat, idle, event_time, keep), BLOCKS)


def stitch_discard_stream(chunks: DataFrame, config: ChunkConfig, idle: int | None = None, event_time: str | None = None, keep: int = KEEP) -> DataFrame:
    """rec, BLOCKS: the centres of chunks; what the last one doesn't reach is silent, and so is the place of a chunk that is lost."""
    return _run(chunks, _Discard(config, idle, event_time, keep), BLOCKS)


def utterances(events: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """rec, start, end, n of runs of events (rec, ts) without a longer gap; later data than the watermark is dropped."""
    x = events.withWatermark("ts", late).groupBy("rec", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return x.select("rec", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


TIMELINE = "session long, upto long, turns array<struct<start_ms: long, end_ms: long, speaker: string>>, n_turns long, speakers int, active int, largest int, late long"


def _most_at_once(turns: list[tuple[int, int, str]]) -> int:
    """The most speakers that overlap. A speaker counts once, and turns that touch don't overlap."""
    by: dict[str, list[tuple[int, int]]] = {}
    for start, end, speaker in sorted(turns):
        own = by.setdefault(speaker, [])
        if own and start <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], end))
        elif end > start:
            own.append((start, end))
    steps = sorted((t, d) for own in by.values() for s, e in own for t, d in ((s, 1), (e, -1)))
    return int(np.cumsum([d for _, d in steps]).max(initial=0)) if steps else 0


class _Timeline(_Recording):
    """Open turns are the map's entries, by number; closed ones are what the head has summed up. session: the reset row it began with."""

    HEAD = f"{_Recording.HEAD}, session long, upto long, n long, largest int, latest long, late long, speakers array<string>"
    FRESH = (*_Recording.FRESH, -1, -1, 0, 0, -1, 0, [])
    WAITING = "start_ms long, end_ms long, speaker string"

    def __init__(self, closing: int | None, *how):
        super().__init__(*how)
        self.closing = closing

    def take(self, key, head, came):
        head[3] = False
        rows = sorted((r for x in came for r in x.itertuples()), key=lambda r: r.seq)
        turns = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        was = dict(turns)
        session, upto, n, largest, latest, late, speakers = head[4:]
        speakers = set(speakers)
        for r in rows:
            seq = int(r.seq)
            upto = max(upto, seq)
            if getattr(r, "reset", None):
                if seq > session:
                    session, n, largest, latest, speakers = seq, 0, 0, -1, set()
                    turns = {k: v for k, v in turns.items() if k > seq}
            elif seq < session or seq in turns or (self.closing is not None and r.start_ms < latest - self.closing):
                late += 1
            else:
                turns[seq] = (int(r.start_ms), int(r.end_ms), r.speaker)
                latest = max(latest, int(r.start_ms))
        latest = max([latest, *(t[0] for t in turns.values())])
        largest = max(largest, _most_at_once(list(turns.values())))
        if self.closing is not None:  # no turn to come starts before these have ended
            closed = {k for k, t in turns.items() if t[1] < latest - self.closing}
            n, speakers = n + len(closed), speakers | {turns[k][2] for k in closed}
            turns = {k: t for k, t in turns.items() if k not in closed}
        for k in was.keys() - turns.keys():
            self.waiting.removeKey((k,))
        for k in turns.keys() - was.keys():
            self.waiting.updateValue((k,), turns[k])
        head[1] = len(turns)
        head[4:] = [session, upto, n, largest, latest, late, sorted(speakers)]
        now = {t[2] for t in turns.values() if t[0] <= latest < t[1]}
        row = {"rec": key[0], "session": session, "upto": upto, "turns": [{"start_ms": a, "end_ms": b, "speaker": c} for a, b, c in sorted(turns.values())], "n_turns": n + len(turns), "speakers": len(speakers | {t[2] for t in turns.values()}), "active": len(now), "largest": largest, "late": late}
        yield pd.DataFrame([row])

    def give_up(self, key, head):
        head[3] = True
        for k in [k[0] for k in self.waiting.keys()]:
            t = self.waiting.getValue((k,))
            head[6], head[10] = head[6] + 1, sorted({*head[10], t[2]})
        return iter(())


def live_turns(turns: DataFrame, closing: int | None = None, idle: int | None = None, event_time: str | None = None, keep: int = KEEP) -> DataFrame:
    """rec, TIMELINE: a recording's current timeline after each trigger that brought it a row.

    turns: rec, seq (its place in the recording's stream), speaker, start_ms, end_ms and, if there are resets, reset: such a row
    begins a new session, and what has a smaller seq is no part of it. `turns` are all of the session; with `closing`, those
    that ended at most so many milliseconds before the latest start: earlier ones are summed up and leave the state, and a
    turn that starts before that is late. n_turns, speakers and largest (the most speakers at once) are of the whole session,
    active is who speaks at the latest start. A seq that comes twice is late.
    """
    return _run(turns, _Timeline(closing, idle, event_time, keep), TIMELINE, "update")


def live_timeline(turns: DataFrame) -> DataFrame:
    """rec, turns, speakers, end_ms so far. Where turns have an `epoch`, a reset starts the next one, with a timeline of its own."""
    own = [k for k in ("rec", "epoch") if k in turns.columns]
    return turns.groupBy(*own).agg(F.count("*").alias("turns"), F.size(F.collect_set("speaker")).alias("speakers"), F.max("end_ms").alias("end_ms"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def progress(events: DataFrame) -> DataFrame:
    """stage, pct: the furthest progress so far, 100 at most."""
    return events.groupBy("stage").agg(F.least(F.lit(100.0), F.max("pct")).alias("pct"))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, write its result to the shared folder and read that. complete: the last trigger's rows; update: those of all triggers."""
    spark: SparkSession = df.sparkSession
    path = scratch(spark)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", path).start()
    elif mode == "update":
        q = w.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()  # a batch that is tried again replaces itself
    else:
        q = w.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
