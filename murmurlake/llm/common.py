"""What the corpus operators share: table access, lineage cuts, vectorised word hashing, packed exchanges, components.

Conventions that hold for every operator of this package:

* A row without ``doc_id`` is no document: no result could name it, so it is left out.
* Only the columns an operator names are read; further columns, whatever their names, are ignored.
* Rows that repeat a ``doc_id`` are documents of their own. Results are joined back on the id and the
  hash of the text, so a repeated row gets the same result as its twin and two texts under one id don't mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import settle as cut

#: Bytes of text that a task hashes at a time; its arrays take about 60 times as much.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and 32 bits of a hash of the text, which tell apart rows under one id."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash("text").alias("th"))


def text_hash(text):
    return F.xxhash64(F.col(text) if isinstance(text, str) else text).bitwiseAND(F.lit(0xFFFFFFFF))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, by which exchanges are sized."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(size: int, each: int = 12_000_000) -> int:
    """Buckets of a packed exchange: each holds about what `each` bytes of text give, at any input size."""
    return max(8, math.ceil(size / each))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has at most so many rows; else leave the join to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ---------------------------------------------------------------- words and hashes

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def space_words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space; bytes.split() parts at exactly those six characters."""
    return text.split()


def plain_words(text: bytes) -> list[bytes]:
    """A-Z in lower case; runs of ASCII letters, digits and whatever is outside ASCII."""
    return text.translate(_LOWER).split()


_LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_space_words(text: bytes) -> list[bytes]:
    """A-Z in lower case; runs of anything but ASCII white space."""
    return text.translate(_LOWER_AZ).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def factors(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Words:
    """The words of some texts as arrays: all words' hashes, the text of each, and its place in that text."""

    def __init__(self, texts: list[list[bytes]]):
        self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.total = int(self.counts.sum())
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.buffer = np.frombuffer(b" ".join([b" ".join(t) for t in texts if t]) + b" ", np.uint8) if self.total else np.zeros(0, np.uint8)
        self.ends = np.flatnonzero(self.buffer == 32) if self.total else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if self.total else self.ends

    def hashes(self, seed: int) -> np.ndarray:
        """64 bits of each word."""
        if not self.total:
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts + 1
        table = factors(int(lengths.max()), seed)
        place = np.arange(len(self.buffer)) - np.repeat(self.starts, lengths)
        with np.errstate(over="ignore"):
            value = table[place] * (self.buffer.astype(np.uint64) + np.uint64(1))
            return mix(np.add.reduceat(value, self.starts))

    def within(self, n: int) -> np.ndarray:
        """Where n consecutive words of one text start."""
        last = self.total - n + 1
        return np.flatnonzero(self.owner[:last] == self.owner[n - 1 :]) if last > 0 else np.zeros(0, np.int64)


def window_hashes(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The hash of x[i:i+n] for every i that has so many."""
    last = len(x) - n + 1
    if last <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(last, np.uint64)
        for j, f in enumerate(factors(n, seed)):
            out += x[j : j + last] * f
        return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES, text: str = "text") -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows and their texts as bytes (null: empty) in chunks of about `size` bytes; no text is cut."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        at = n = 0
        texts: list[bytes] = []
        for i in range(len(column)):
            t = column[i].as_py() or b""
            texts.append(t)
            n += len(t)
            if n >= size:
                yield rows.slice(at, i + 1 - at), texts
                at, n, texts = i + 1, 0, []
        if texts:
            yield rows.slice(at), texts


# ---------------------------------------------------------------- packed exchange


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned numbers, lowest bytes first: planes of equal bytes cost a shuffle next to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def names_of(ids: np.ndarray, ths: np.ndarray) -> dict[str, bytes]:
    """Texts' ids, as differences, and hashes."""
    return {"ids": planes(np.diff(ids, prepend=0), 8), "ths": planes(ths, 4)}


def named(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(unplanes(row["ids"], 8).astype(np.int64)), unplanes(row["ths"], 4).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket by the 24 highest bits."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places it has, in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(bucket[part[0]]), part


PACKED = "bucket int, ids binary, ths binary, starts binary, hashes binary, gaps binary, grp int"
PLACES = "doc_id long, th long, places binary"


def pack(ids: np.ndarray, ths: np.ndarray, words, at: np.ndarray, bucket: np.ndarray, *stored: tuple[np.ndarray, int]) -> Iterator[dict]:
    """Rows of PACKED: by bucket, the hashes (with their widths in bytes) of some places and the texts they lie in."""
    for b, part in by_bucket(bucket):
        place = at[part]
        own = words.owner[place]
        first = np.flatnonzero(np.diff(own, prepend=-1))  # places ascend, so owners do
        docs = own[first]
        yield {"bucket": b, **names_of(ids[docs], ths[docs]), "starts": planes(np.diff(words.offsets[docs], prepend=0), 5), "hashes": b"".join(planes(x[part], w) for x, w in stored), "gaps": planes(np.diff(place, prepend=0), 4)}


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("ids", "ths", "starts", "hashes", "gaps")), ("grp", pa.int32())])


def passed_on(done: pa.Table, buckets: int, sizes: str = "starts", gaps: str = "gaps") -> list[dict]:
    """Answers that a chunk could give itself, as rows of an exchange: they go through a bucket unread, so a window that many texts of a chunk share is one entry there."""
    return [{"bucket": r["grp"] % buckets, "ids": r["ids"], "ths": r["ths"], sizes: r["sizes"], gaps: r["gaps"], "grp": r["grp"]} for r in done.to_pylist()]


def told_apart(group: pa.Table, sizes: str = "starts", gaps: str = "gaps") -> tuple[pa.Table, pa.Table]:
    """A bucket's own rows, and the answers that only pass through."""
    own = pa.compute.is_null(group["grp"])
    done = group.filter(pa.compute.invert(own))
    return group.filter(own), pa.table([done["grp"], done["ids"], done["ths"], done[sizes], done[gaps]], schema=ANSWERS_ARROW)


def unpack(group: pa.Table, *widths: int) -> tuple[np.ndarray, ...]:
    """Of a bucket: hashes, place in the text and text's number for each entry; id and text hash for each text."""
    hashes, place, owner, ids, ths, n = [[] for _ in widths], [], [], [], [], 0
    for r in group.to_pylist():
        at = np.cumsum(unplanes(r["gaps"], 4).astype(np.int64))
        starts = np.cumsum(unplanes(r["starts"], 5).astype(np.int64))
        own = np.searchsorted(starts, at, side="right") - 1
        ends = np.cumsum(widths) * len(at)
        for k, (w, end) in enumerate(zip(widths, ends.tolist(), strict=True)):
            hashes[k].append(unplanes(r["hashes"][end - w * len(at) : end], w))
        place.append(at - starts[own])
        owner.append(own + n)
        id_, th = named(r)
        ids.append(id_)
        ths.append(th)
        n += len(starts)
    return tuple(map(np.concatenate, (*hashes, place, owner, ids, ths)))


def answers(chosen: np.ndarray, place: np.ndarray, owner: np.ndarray, ids: np.ndarray, ths: np.ndarray, groups: int) -> pa.Table:
    """The chosen entries, packed by group of texts: what a bucket says of a text travels with what it says of others."""
    at = np.flatnonzero(chosen)
    rows = []
    if len(at):
        group = bucket_of(mix(ids.astype(np.uint64) ^ mix(ths.astype(np.uint64))), groups)[owner[at]]
        for g, part in by_bucket(group):
            k = at[part]
            k = k[np.lexsort((place[k], owner[k]))]
            first = np.flatnonzero(np.diff(owner[k], prepend=-1))
            gap = np.diff(place[k], prepend=0)
            gap[first] = place[k[first]]
            docs = owner[k[first]]
            rows.append({"grp": g, **names_of(ids[docs], ths[docs]), "sizes": planes(np.diff(np.append(first, len(k))), 4), "gaps": planes(gap, 4)})
    return pa.Table.from_pylist(rows, schema=ANSWERS_ARROW)


ANSWERS = "grp int, ids binary, ths binary, sizes binary, gaps binary"
ANSWERS_ARROW = pa.schema([("grp", pa.int32()), *((k, pa.binary()) for k in ("ids", "ths", "sizes", "gaps"))])


def merged_answers(group: pa.Table) -> pa.Table:
    """Rows of PLACES, one for each text of a group."""
    ids, ths, size, place = [], [], [], []
    for r in group.to_pylist():
        n, gap = unplanes(r["sizes"], 4).astype(np.int64), unplanes(r["gaps"], 4).astype(np.int64)
        run, first = np.cumsum(gap), np.cumsum(n) - n
        id_, th = named(r)
        ids.append(id_)
        ths.append(th)
        size.append(n)
        place.append(run - np.repeat(run[first] - gap[first], n))
    ids, ths, size, place = map(np.concatenate, (ids, ths, size, place))
    key, of = np.unique(np.stack([ids, ths], axis=1), axis=0, return_inverse=True)
    of = np.repeat(of.reshape(-1), size)
    order = np.lexsort((place, of))
    of, place = of[order], place[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    gap = np.diff(place, prepend=0)
    gap[first] = place[first]
    ends = np.append(first[1:], len(of))
    return pa.table({"doc_id": pa.array(key[of[first], 0]), "th": pa.array(key[of[first], 1]), "places": pa.array([planes(gap[a:b], 4) for a, b in zip(first, ends, strict=True)], pa.binary())})


def read_places(places: bytes | None) -> np.ndarray:
    """The places of a row of PLACES, in order."""
    return np.unique(np.cumsum(unplanes(places or b"", 4).astype(np.int64)))


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie within `length` of a start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) in any direction; the component is the smallest node reachable.

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its smallest one, then its
    smaller neighbours are. Both keep reachability and lose length fast, so the end is sure; sums per node are made before
    the shuffle. Each round is written, so lost executors cost no more than a round.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct())
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
