"""Document fingerprints by order min-hash: signatures that tell how far two texts are apart in edits, not in sets only.

A text's k-mers are its windows of K code points (a shorter text is one k-mer, the empty text has none). Equal ones are told
apart by their occurrence, so repeats count. Each of SKETCHES orders of (k-mer, occurrence) picks the TUPLE smallest; these
are put back in the order of the text, and the k-mers in that order are hashed. Texts agree in a sketch when they share its
smallest k-mers in the same order; the likeness of two fingerprints is the share of sketches they agree in.

The next document is the one with the next smaller doc_id, after the last the first; rows that repeat an id follow each other
by the hash of their texts. Texts are dealt once, by ranges of that order, and read in it: a task keeps one text until it has
seen the next. Where a range ends, its last text waits for the first one of the range after it, which is a join of two rows a
range. No text is cut, but the head that the contract takes of the next one.

Defined results: null is the empty text; the empty text has a fingerprint of its own, so two empty texts are alike (1.0); a
table of one row is followed by itself; an empty table gives no rows. Rows without doc_id are left out. Rows equal in id and
text give equal fingerprints, and lie in one range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, factors, mix, table

K, SKETCHES, TUPLE = 5, 64, 2
SEED = 1109
#: Cells that the sketches of a text take up at a time.
CELLS = 1 << 18


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-mer, in the order of the text."""
    if not len(points):
        return np.zeros(0, np.uint64)
    x = points.astype(np.uint64) + np.uint64(1)
    f = factors(max(k, 1), SEED)
    n = max(1, len(x) - k + 1)
    with np.errstate(over="ignore"):
        if len(x) < k:
            return mix((x * f[: len(x)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x)))
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += x[j : j + n] * f[j]
        return mix(out)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each; told by the bits that a sortable word has left beside the place."""
    bits = np.uint64(max(1, int(len(h) - 1).bit_length()))
    place = np.uint64((1 << int(bits)) - 1)
    order = np.sort((h & ~place) | np.arange(len(h), dtype=np.uint64))
    head = order >> bits
    first = np.concatenate([[True], head[1:] != head[:-1]])
    at = np.arange(len(h))
    out = np.empty(len(h), np.uint64)
    out[(order & place).astype(np.int64)] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def fingerprint(points: np.ndarray, k: int = K, sketches: int = SKETCHES, least: int = TUPLE) -> np.ndarray:
    """32 bits for each sketch of a text given as code points."""
    h = kmers(points, k)
    if not len(h):
        return np.zeros(sketches, np.uint32)
    with np.errstate(over="ignore"):
        rank = (mix(h + occurrences(h) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        orders = (factors(sketches, SEED + 1) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        size, step = min(least, len(h)), max(1, CELLS // len(h))
        chosen = np.empty((sketches, size), np.int64)
        for a in range(0, sketches, step):
            cells = orders[a : a + step, None] * rank[None, :]
            own = np.arange(len(cells))
            for j in range(size):
                chosen[a : a + step, j] = at = cells.argmin(axis=1)
                cells[own, at] = 0xFFFFFFFF
        chosen.sort(axis=1)
        return (mix((h[chosen] * factors(size, SEED + 2)).sum(axis=1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def points_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last third gives way to as many code points of the next text's head, or to all it has."""
    n = len(points) // 3
    return np.concatenate([points[: len(points) - n], following[:n]])


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_PRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: At the edges of a range: its number, its last text, and the text and fingerprint it begins with.
EDGES = "part int, last string, first string, first_fingerprint binary"
_EDGES = pa.schema([("part", pa.int32()), ("last", pa.string()), ("first", pa.string()), ("first_fingerprint", pa.binary())])


def _row(doc_id: int, points: np.ndarray, own: np.ndarray, following: np.ndarray, next_own: np.ndarray, make) -> dict:
    x = edited(points, following)
    other = make(x)
    return {"doc_id": doc_id, "n_chars": len(points), "edited_sha256": hashlib.sha256(text_of(x).encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own.tobytes(), "edited_fingerprint": other.tobytes(), "near_edited": likeness(own, other), "near_next": likeness(own, next_own)}


def fingerprints(docs: DataFrame, k: int = K, sketches: int = SKETCHES, least: int = TUPLE, ranges: int | None = None) -> DataFrame:
    """PRINTS: each document's fingerprint, that of its edited text, and how like it is to that text and to the next document.

    `ranges` is the number of ranges that documents are dealt to; spark.sql.shuffle.partitions if it isn't given.
    """

    def make(points: np.ndarray) -> np.ndarray:
        return fingerprint(points, k, sketches, least)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = was = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = points_of(text)
                own = make(points)
                if was:
                    out.append(_row(*was, points, own, make))
                head, was = head or (text or "", own), (doc_id, points, own)
            yield pa.RecordBatch.from_pylist(out, schema=pa.unify_schemas([_PRINTS, _EDGES]))
        if was:
            edge = {"part": TaskContext.get().partitionId(), "doc_id": was[0], "n_chars": len(was[1]), "fingerprint": was[2].tobytes(), "last": text_of(was[1]), "first": head[0], "first_fingerprint": head[1].tobytes()}
            yield pa.RecordBatch.from_pylist([edge], schema=pa.unify_schemas([_PRINTS, _EDGES]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_row(r["doc_id"], points_of(r["last"]), np.frombuffer(r["fingerprint"], np.uint32), points_of(r["first"]), np.frombuffer(r["first_fingerprint"], np.uint32), make) for r in batch.to_pylist()], schema=_PRINTS)

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    order = [F.col("doc_id").desc(), F.col("th")]
    dealt = texts.repartitionByRange(ranges, *order) if ranges else texts.repartitionByRange(*order)
    x = cut(dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(follow, f"{PRINTS}, {EDGES}"))
    edges = x.where("part IS NOT NULL")
    # One number for each range meets in a task, no texts.
    after = edges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    heads = edges.select(F.col("part").alias("next_part"), "first", "first_fingerprint")
    met = edges.select("part", "doc_id", "fingerprint", "last").join(after, "part").join(heads, "next_part").select("doc_id", "fingerprint", "last", "first", "first_fingerprint")
    return x.where("part IS NULL").select(*_PRINTS.names).unionByName(met.mapInArrow(meet, PRINTS))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fingerprints(table(spark, sf_dir, "documents"))
    return x.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
