"""Toxicity from class-conditional Kneser-Ney models.

Two models of words as byte sequences, of texts labelled toxic and of texts labelled ordinary, are compared by the
difference of the log-likelihoods they give a word. Each is an interpolated Kneser-Ney model of up to ORDER bytes, a word's
leading and closing space included: counts are discounted, and what that frees goes to the next shorter context, whose
counts say how many different bytes precede. A context that a class doesn't have changes nothing; below one that it has, the
shorter ones mix the class's own estimate with that of both classes
together (SHARED), so that rare expressions rest on shared backoff counts, whether the n-gram itself was seen or not: after
any context the probabilities of all bytes sum to 1 in each model.

The corpus is spelt once: of each chunk of texts the distinct words are written, by bucket of their hash, and its texts as
numbers of these words. Distinct words of a bucket are one, with their counts in either class; n-grams are summed from
them, and continuation and history counts come from joins over all n-grams. The model is a written table without a bound:
distinct words ask for their n-grams in buckets of the key, put the answers together to their difference, and send that
back to the chunks that hold them. Neither the driver nor a task ever holds the model.

Training rows have crc32(doc_id) mod 5 in 1..4. At most CALIBRATE labelled ids of those with 1, a documented bound, are not
counted: on them a logistic curve turns differences into a score. All other training rows are counted.
Features, from the differences of a text's words: their mean (the length-normalised log-likelihood ratio), and three that
keep a short toxic passage of a long text from being averaged away: the mean times the square root of the length, the mean
of the TOP most toxic words, and how many are over STRONG.

Defined results: null and empty texts have no words and get the curve's value for no evidence; a doc_id that is labelled
more than once takes the largest label; rows with a null label are not learnt from; without counted rows of both classes
every score is 0, and where only the curve lacks rows of both, it is the logistic function of the mean alone; repeated rows each get the same score; long texts are whole: their words count as often as they occur.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, bounded_broadcast, bucket_of, buckets_for, by_bucket, chunks, cut, mix, plain_words, planes, table, text_bytes, unplanes

ORDER = 7
SHARED = 0.5
CALIBRATE = 20_000
DISCOUNT = 0.75
TOP = 8
STRONG = 3.0
SEED = 2

COUNTS = "bucket int, keys binary, toxic binary, plain binary"
COUNTS_ARROW = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("keys", "toxic", "plain"))])
GRAMS = "gram long, n int, toxic long, plain long"
SPELT = "bucket int, chunk long, first int, words binary, toxic binary, plain binary, ids binary, roles binary, sizes binary, at binary, times binary"
SPELT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("first", pa.int32()), *((k, pa.binary()) for k in ("words", "toxic", "plain", "ids", "roles", "sizes", "at", "times"))])
DISTINCT = "bucket int, chunk long, first int, words binary, toxic binary, plain binary, at binary"
DISTINCT_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("first", pa.int32()), *((k, pa.binary()) for k in ("words", "toxic", "plain", "at"))])
ASKED = "grams int, bucket int, keys binary"
ASKED_ARROW = pa.schema([("grams", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary())])
NUMBERS = ["ut", "up", "ht", "hp", "dt", "dp", "du"]
TOLD_ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), *((k, pa.binary()) for k in NUMBERS)])
TOLD = "bucket int, keys binary, " + ", ".join(f"{k} binary" for k in NUMBERS)
VALUED = "bucket int, value binary"
BACK = "chunk long, first int, value binary"
#: What a row is for: neither, counted (ordinary, toxic), the curve (ordinary, toxic).
COUNTED, CURVE = (1, 2), (3, 4)
#: Packed bytes of distinct words to a bucket of n-grams.
GRAM_BYTES = 500_000


class Spelt:
    """The distinct words of some texts, each between two spaces, as one run of bytes."""

    def __init__(self, words: Words):
        _, self.first, self.of = np.unique(words.hashes(SEED), return_index=True, return_inverse=True)
        length = (words.ends - words.starts)[self.first] + 2
        self.begin = np.cumsum(length) - length
        self.word = np.repeat(np.arange(len(self.first)), length)
        self.place = np.arange(length.sum()) - self.begin[self.word]
        at = words.starts[self.first][self.word] + self.place - 1
        inner = (self.place > 0) & (self.place < length[self.word] - 1)
        self.bytes = np.where(inner, words.buffer[np.where(inner, at, 0)], 32).astype(np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a byte has n - 1 before it in its word, and the n-gram that ends there. The leading space only precedes."""
        at = np.flatnonzero((self.place >= n - 1) & (self.place > 0))
        key = np.full(len(at), 1, np.uint64)
        for j in range(n - 1, -1, -1):
            key = (key << np.uint64(8)) | self.bytes[at - j]
        return at, key


def order_of(gram: np.ndarray) -> np.ndarray:
    """An n-gram's key is its bytes after a leading 1."""
    n = np.zeros(len(gram), np.int32)
    for j in range(1, ORDER + 1):
        n += gram >= np.uint64(1 << (8 * j))
    return n


def suffix(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Without the first byte."""
    top = np.uint64(1) << (np.uint64(8) * (n - 1).astype(np.uint64))
    return (gram & (top - np.uint64(1))) | top


def counted(keys: np.ndarray, toxic: np.ndarray, plain: np.ndarray, n: int) -> list[dict]:
    """Rows of COUNTS: how often each key occurs in toxic and in other texts, by bucket."""
    found, of = np.unique(keys, return_inverse=True)
    t, p = (np.bincount(of, x, len(found)).astype(np.uint64) for x in (toxic, plain))
    return [{"bucket": b, "keys": planes(found[k], 8), "toxic": planes(t[k], 8), "plain": planes(p[k], 8)} for b, k in by_bucket(bucket_of(mix(found), n))]


def summed(group: pa.Table) -> pa.Table:
    keys = np.concatenate([unplanes(x, 8) for x in group["keys"].to_pylist()])
    found, of = np.unique(keys, return_inverse=True)
    t, p = (np.bincount(of, np.concatenate([unplanes(x, 8) for x in group[c].to_pylist()]).astype(float), len(found)).astype(np.int64) for c in ("toxic", "plain"))
    return pa.table({"gram": pa.array(found.astype(np.int64)), "n": pa.array(order_of(found)), "toxic": pa.array(t), "plain": pa.array(p)})


def small(data: bytes) -> bytes:
    """What is written once and shuffled once costs the disk less than a shuffle's own codec would leave."""
    return zlib.compress(data, 6)


def small_planes(x: np.ndarray) -> bytes:
    return small(planes(x, 8))


def small_read(data: bytes) -> np.ndarray:
    return unplanes(zlib.decompress(data), 8)


def words_in(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b" ")


def spelt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of SPELT for each chunk: its distinct words by bucket, and (bucket -1) its texts as places among them, each once."""
    for rows, texts in chunks(batches, 6_000_000):
        words = Words([plain_words(t) for t in texts])
        chunk, roles, out = uuid.uuid4().int >> 65, rows["role"].to_numpy(), []
        owner = gap = times = np.zeros(0, np.int64)
        if words.total:
            h, first, of = np.unique(words.hashes(SEED), return_index=True, return_inverse=True)
            toxic, plain = (np.bincount(of, roles[words.owner] == k, len(h)) for k in COUNTED[::-1])
            data = words.buffer.tobytes()
            each = [data[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
            # Hashes ascend, so a bucket's words stand together.
            out = [{"bucket": b, "chunk": chunk, "first": int(k[0]), "words": small(b" ".join(each[k[0] : k[-1] + 1])), "toxic": small_planes(toxic[k]), "plain": small_planes(plain[k])} for b, k in by_bucket(bucket_of(h, buckets))]
            key, times = np.unique(words.owner * len(h) + of, return_counts=True)
            owner, place = key // len(h), key % len(h)
            gap, begin = np.diff(place, prepend=0), np.flatnonzero(np.diff(owner, prepend=-1))
            gap[begin] = place[begin]
        out.append({"bucket": -1, "chunk": chunk, "first": 0, "ids": small_planes(rows["doc_id"].to_numpy()), "roles": small(roles.astype(np.uint8).tobytes()), "sizes": small_planes(np.bincount(owner, minlength=len(texts))), "at": small_planes(gap), "times": small_planes(times)})
        yield pa.RecordBatch.from_pylist(out, schema=SPELT_ARROW)


def distinct(group: pa.Table) -> pa.Table:
    """A bucket's words, each once, in the order of their hashes; and for each chunk which of them it has, in that order."""
    rows = group.to_pylist()
    words = Words([words_in(r["words"]) for r in rows])
    _, first, of = np.unique(words.hashes(SEED), return_index=True, return_inverse=True)
    data = words.buffer.tobytes()
    each = [data[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
    counts = {c: small_planes(np.bincount(of, np.concatenate([small_read(r[c]) for r in rows]).astype(float), len(first))) for c in ("toxic", "plain")}
    own = [{"bucket": r["bucket"], "chunk": r["chunk"], "first": r["first"], "at": small_planes(np.diff(of[a:b], prepend=0))} for r, a, b in zip(rows, words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]
    return pa.Table.from_pylist([{"bucket": rows[0]["bucket"], "words": small(b" ".join(each)), **counts}, *own], schema=DISTINCT_ARROW)


def grams_in(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS for the words that training texts have."""
    for b in batches:
        for row in b.to_pylist():
            t, p = (small_read(row[c]).astype(float) for c in ("toxic", "plain"))
            words = words_in(row["words"])
            kept = np.flatnonzero(t + p)
            if not len(kept):
                continue
            s = Spelt(Words([[words[i] for i in kept.tolist()]]))
            t, p = t[kept][s.first], p[kept][s.first]
            for n in range(1, ORDER + 1):
                at, key = s.grams(n)
                yield pa.RecordBatch.from_pylist(counted(key, t[s.word[at]], p[s.word[at]], buckets), schema=COUNTS_ARROW)


def asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket of words, the n-grams and contexts that its words look up, by bucket of the key."""
    for b in batches:
        for row in b.to_pylist():
            s = Spelt(Words([words_in(row["words"])]))
            # The empty context, and that of a leading space alone.
            keys = [np.array([1, 0x120], np.uint64)]
            for n in range(1, ORDER + 1):
                keys.append(np.unique(s.grams(n)[1]))
            keys = np.unique(np.concatenate(keys))
            yield pa.RecordBatch.from_pylist([{"grams": g, "bucket": row["bucket"], "keys": small_planes(np.diff(keys[k], prepend=np.uint64(0)))} for g, k in by_bucket(bucket_of(mix(keys), buckets))], schema=ASKED_ARROW)


def told_counts(asking: pa.Table, model: pa.Table) -> pa.Table:
    """Of the n-grams asked for in a bucket of the key, those that the model has, with its numbers."""
    out = []
    if model.num_rows:
        gram = model["gram"].to_numpy().astype(np.uint64)
        order = np.argsort(gram)
        gram, numbers = gram[order], {c: model[c].to_numpy()[order] for c in NUMBERS}
        for r in asking.to_pylist():
            key = np.cumsum(small_read(r["keys"]))
            at = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
            hit = gram[at] == key
            if hit.any():
                out.append({"bucket": r["bucket"], "keys": small_planes(np.diff(key[hit], prepend=np.uint64(0))), **{c: small_planes(x[at[hit]]) for c, x in numbers.items()}})
    return pa.Table.from_pylist(out, schema=TOLD_ARROW)


class Model:
    """Numbers of n-grams, and the differences they give to words all whose n-grams have been looked up."""

    def __init__(self, gram: np.ndarray, used: np.ndarray, uses: np.ndarray, different: np.ndarray):
        """used: (n-grams x 2) effective counts; of each as a context, uses (x 2) and different bytes after (x 3: toxic, ordinary, both together)."""
        order = np.argsort(gram)
        # The empty context's row is key 1, of order 0.
        self.gram = gram[order]
        self.used, self.total = (np.concatenate([x[order], x[order].sum(axis=1, keepdims=True)], axis=1) for x in (used, uses))
        self.some = self.total > 0
        self.pass_on = np.where(self.some, DISCOUNT * different[order] / np.maximum(self.total, 1), 1.0)

    def find(self, gram: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        return np.where(self.gram[at] == gram, at, -1)

    def probabilities(self, s: Spelt) -> np.ndarray:
        """Of each byte after those before it in its word: toxic, ordinary, shared. An n-gram that isn't there leaves what its context passes on."""
        p = np.full((len(s.bytes), 3), 1 / 256)
        for n in range(1, ORDER + 1) if len(self.gram) else ():
            at, key = s.grams(n)
            row, context = self.find(key), self.find(key >> np.uint64(8))
            known = (context >= 0)[:, None] & self.some[context]
            low = p[at].copy()
            low[:, :2] = (1 - SHARED) * low[:, :2] + SHARED * low[:, 2:]
            own = np.where((row >= 0)[:, None], np.maximum(self.used[row] - DISCOUNT, 0), 0) / np.maximum(self.total[context], 1)
            p[at] = np.where(known, own + self.pass_on[context] * low, p[at])
        return p

    def differences(self, s: Spelt) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each distinct word."""
        p = self.probabilities(s)
        return np.add.reduceat(np.log(p[:, 0] / p[:, 1]), s.begin)


def valued(words: pa.Table, told: pa.Table) -> pa.Table:
    """The differences of a bucket's words, in the order of their hashes."""
    rows = words.to_pylist()
    if not rows:
        return pa.table({"bucket": pa.array([], pa.int32()), "value": pa.array([], pa.binary())})
    numbers = told.to_pylist()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(small_read(r["keys"])) for r in numbers)])
    ut, up, ht, hp, dt, dp, du = (np.concatenate([np.zeros(0), *(small_read(r[c]).astype(float) for r in numbers)]) for c in NUMBERS)
    model = Model(keys, np.stack([ut, up], axis=1), np.stack([ht, hp], axis=1), np.stack([dt, dp, du], axis=1))
    d = model.differences(Spelt(Words([words_in(rows[0]["words"])])))
    return pa.table({"bucket": pa.array([rows[0]["bucket"]], pa.int32()), "value": pa.array([d.astype("<f4").tobytes()], pa.binary())})


def given_back(words: pa.Table, values: pa.Table) -> pa.Table:
    """The differences of a bucket's words to each chunk that holds some of them."""
    rows = words.to_pylist()
    value = np.frombuffer(values["value"][0].as_py(), "<f4") if rows else None
    found = [value[np.cumsum(small_read(r["at"]).astype(np.int64))].tobytes() for r in rows]
    return pa.table({"chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "first": pa.array([r["first"] for r in rows], pa.int32()), "value": pa.array(found, pa.binary())})


def features(texts: pa.Table, values: pa.Table) -> pa.Table:
    """Of a chunk's texts: doc_id, role and FEATURES."""
    parts = sorted(values.to_pylist(), key=lambda r: r["first"])
    value = np.concatenate([np.zeros(0), *(np.frombuffer(r["value"], "<f4") for r in parts)]).astype(np.float64)
    out = []
    for r in texts.to_pylist():
        sizes, gap, times = (small_read(r[c]).astype(np.int64) for c in ("sizes", "at", "times"))
        owner, ends, run = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes), np.cumsum(gap)
        first = (ends - sizes)[owner]
        d = value[run - run[first] + gap[first]]
        counts = np.bincount(owner, times, len(sizes))
        x = np.zeros((len(sizes), 4))
        mean = np.bincount(owner, d * times, len(sizes)) / np.maximum(counts, 1)
        x[:, 0], x[:, 1] = mean, mean * np.sqrt(counts)
        x[:, 3] = np.log1p(np.bincount(owner, times * (d > STRONG), len(sizes)))
        for i in np.flatnonzero(sizes):
            y, n = d[ends[i] - sizes[i] : ends[i]], times[ends[i] - sizes[i] : ends[i]]
            k = np.argsort(y)[: -TOP - 1 : -1]
            x[i, 2] = np.repeat(y[k], np.minimum(n[k], TOP))[:TOP].sum() / TOP
        out.append((small_read(r["ids"]).astype(np.int64), np.frombuffer(zlib.decompress(r["roles"]), np.uint8).astype(np.int32), x))
    ids, roles, x = (np.concatenate(k) for k in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, 4)))
    return pa.table({"doc_id": pa.array(ids), "role": pa.array(roles), **{k: pa.array(x[:, i]) for i, k in enumerate(FEATURES)}})


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last is the constant), by Newton's method with a small penalty."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 0.1 * w
        w -= np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + 0.1 * np.eye(len(w)), g)
        if np.abs(g).max() < 1e-6:
            break
    return centre, scale, w


def remainder():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def counts_of(words: DataFrame, buckets: int) -> DataFrame:
    """The model: each n-gram and context with the numbers that probabilities are made of, and its bucket. words: DISTINCT."""
    grams = cut(words.mapInArrow(lambda it: grams_in(it, buckets), COUNTS).groupBy("bucket").applyInArrow(summed, GRAMS))
    first = F.expr("shiftright(gram, 8 * (n - 1)) & 255")
    shorter = F.expr("(gram & (shiftleft(1L, 8 * (n - 1)) - 1)) | shiftleft(1L, 8 * (n - 1))")
    before = grams.where("n > 1").groupBy(shorter.alias("gram")).agg(F.count_if(F.col("toxic") > 0).alias("ct"), F.count_if(F.col("plain") > 0).alias("cp"))
    whole = (F.col("n") == ORDER) | (first == 32)
    used = grams.join(before, "gram", "left").select("gram", *(F.when(whole, F.col(a)).otherwise(F.coalesce(b, F.lit(0))).cast("long").alias(c) for a, b, c in (("toxic", "ct", "ut"), ("plain", "cp", "up"))))
    after = used.groupBy(F.shiftright("gram", 8).alias("gram")).agg(F.sum("ut").alias("ht"), F.sum("up").alias("hp"), F.count_if(F.col("ut") > 0).alias("dt"), F.count_if(F.col("up") > 0).alias("dp"), F.count_if(F.col("ut") + F.col("up") > 0).alias("du"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("grams", pa.array(bucket_of(mix(b.column("gram").to_numpy().astype(np.uint64)), buckets).astype(np.int32)))

    numbers = used.join(after, "gram", "full_outer").select("gram", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NUMBERS))
    return cut(numbers.mapInArrow(dealt, "gram long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", grams int"))


def differences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, role and FEATURES of each document. docs: doc_id, text; labels: doc_id, toxic."""
    told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(remainder() != 0)
    curve = told.where(remainder() == 1).join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATE).select("doc_id", F.lit(CURVE[0] - COUNTED[0]).alias("more"))
    told = cut(told.join(F.broadcast(curve), "doc_id", "left").select("doc_id", (F.col("toxic") + COUNTED[0] + F.coalesce("more", F.lit(0))).alias("role")))
    rows = docs.join(bounded_broadcast(told, 2_000_000), "doc_id", "left").select("doc_id", "text", F.coalesce("role", F.lit(0)).alias("role"))
    buckets = buckets_for(text_bytes(docs))
    chunked = cut(rows.mapInArrow(lambda it: spelt(it, buckets), SPELT))
    found = cut(chunked.where("bucket >= 0").select("bucket", "chunk", "first", "words", "toxic", "plain").groupBy("bucket").applyInArrow(distinct, DISTINCT))
    words = found.where("chunk IS NULL").select("bucket", "words", "toxic", "plain")
    size = words.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    grams = max(8, math.ceil(size / GRAM_BYTES))
    model = counts_of(words, grams)
    known = words.mapInArrow(lambda it: asked(it, grams), ASKED).groupBy("grams").cogroup(model.groupBy("grams")).applyInArrow(told_counts, TOLD)
    value = words.select("bucket", "words").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(valued, VALUED)
    back = found.where("chunk IS NOT NULL").select("bucket", "chunk", "first", "at").groupBy("bucket").cogroup(value.groupBy("bucket")).applyInArrow(given_back, BACK)
    texts = chunked.where("bucket < 0").select("chunk", "ids", "roles", "sizes", "at", "times")
    return cut(texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(features, "doc_id long, role int, " + ", ".join(f"{k} double" for k in FEATURES)))


FEATURES = ["mean", "root", "top", "strong"]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, llr for each document."""
    x = differences(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels)
    told = x.where(F.col("role").isin(*CURVE)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATE).toPandas()
    if x.where(F.col("role").isin(*COUNTED)).select("role").distinct().count() < 2:
        return x.select("doc_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("llr"))
    if told["role"].nunique() < 2:
        return x.select("doc_id", (1 / (1 + F.exp(-F.col("mean")))).alias("score"), F.col("mean").alias("llr"))
    centre, scale, w = logistic(told[FEATURES].to_numpy(), (told["role"] == CURVE[1]).to_numpy(float))
    z = F.lit(float(w[-1]))
    for k, c, s, f in zip(FEATURES, centre, scale, w, strict=False):
        z = z + (F.col(k) - float(c)) / float(s) * float(f)
    return x.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"), F.col("mean").alias("llr"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return x.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "llr")
