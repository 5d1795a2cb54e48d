"""Substring deduplication with fixed-block anchors.

Every text is cut into non-overlapping blocks of `block` words; these are the index. Every rolling window of `block`
words, of all texts, probes it. A repeat of `length` words holds one whole block at each of its places when
2 * block - 1 <= length, so each place of each repeat has a probe that hits a block elsewhere. Hits are then extended:
every window of `length` words around a hit is counted over all texts, and runs of windows that occur twice or more are
the maximal exact repeats.

Blocks and probes meet in buckets of their hash, packed as planes of bytes (common.pack), about five bytes a probe; the
bucket and 32 more bits identify a probe, which only chooses candidates. The windows of the second step are identified
by 64 bits and the bucket, taken from two independent hashes. Neither step makes pairs: a bucket counts places by hash.
What a chunk of texts can tell by itself never reaches a bucket: places that share a window with another place of the
chunk are answered there, and one of them stands for all. So a window that a third of all texts share is one entry a chunk.

Defined results: null and empty texts have no words and lose none; kept_sha256 is that of the empty string there. A
repeated row is a place elsewhere, so both lose what they share. Texts shorter than `length` words lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ANSWERS, PACKED, PACKED_ARROW, PLACES, Words, answers, batch_of, bucket_of, buckets_for, chunks, covered, documents, merged_answers, mix, pack, passed_on, read_places, space_words, table, text_bytes, told_apart, unpack, window_hashes

LENGTH = 35
BLOCK = 18
SEED_WORD, SEED_PROBE, SEED_WINDOW, SEED_BUCKET = 11, 12, 13, 14


def starts_in_group(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where each hash starts in that order, and how many places each has."""
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    return order, first, np.diff(np.append(first, len(h)))


def repeated_places(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The texts, dealt by id, and (doc_id, th, starts) of the windows of `length` words that start at two places or more."""
    if 2 * block - 1 > length:
        raise ValueError("a repeat must hold a whole block: 2 * block - 1 <= length")
    docs = documents(docs)
    n = buckets or buckets_for(text_bytes(docs))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            words = Words([space_words(t) for t in texts])
            at = words.within(block)
            h = window_hashes(words.hashes(SEED_WORD), block, SEED_PROBE)[at]
            if len(at):
                ids, ths, owner = rows["doc_id"].to_numpy(), rows["th"].to_numpy(), words.owner[at]
                place = at - words.offsets[owner]
                anchor = place % block == 0
                order, first, size = starts_in_group(h)
                known = np.zeros(len(at), np.int64)
                known[order] = np.repeat(np.add.reduceat(anchor[order].astype(np.int64), first), size)
                hit = known - anchor > 0
                send = ~hit
                # Of several blocks alike, one stands for all.
                both = order[anchor[order] & (known[order] > 1)]
                send[both[np.concatenate([[True], h[both][1:] != h[both][:-1]])] if len(both) else both] = True
                out = list(pack(ids, ths, words, at[send], bucket_of(h[send], n), (h[send], 4)))
                yield batch_of(out + passed_on(answers(hit, place, owner, ids, ths, n), n), PACKED_ARROW)

    def hits(group: pa.Table) -> pa.Table:
        group, done = told_apart(group)
        if not len(group):
            return done
        h, place, owner, ids, ths = unpack(group, 4)
        anchor = place % block == 0
        order, first, size = starts_in_group(h)
        known = np.repeat(np.add.reduceat(anchor[order].astype(np.int64), first), size)
        hit = np.zeros(len(h), bool)
        hit[order] = known - anchor[order] > 0
        return pa.concat_tables([answers(hit, place, owner, ids, ths, n), done])

    def gathered(found: DataFrame) -> DataFrame:
        return found.groupBy("grp").applyInArrow(merged_answers, PLACES)

    texts = docs.repartition("doc_id", "th")
    anchored = docs.mapInArrow(probes, PACKED).groupBy("bucket").applyInArrow(hits, ANSWERS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows around hits, for texts that have any."""
        for rows, texts in chunks(batches):
            words = Words([space_words(t) for t in texts])
            near = np.zeros(words.total + 1, np.int64)
            for k, found in enumerate(rows["places"].to_pylist()):
                hit = read_places(found) + words.offsets[k]
                np.add.at(near, np.maximum(hit - (length - block), words.offsets[k]), 1)
                np.add.at(near, hit + 1, -1)
            at = words.within(length)
            at = at[np.cumsum(near)[at] > 0]
            if len(at):
                x = words.hashes(SEED_WORD)
                h, b = window_hashes(x, length, SEED_WINDOW)[at], window_hashes(words.hashes(SEED_BUCKET), length, SEED_BUCKET)[at]
                ids, ths, owner = rows["doc_id"].to_numpy(), rows["th"].to_numpy(), words.owner[at]
                order, first, size = starts_in_group(mix(h ^ mix(b)))
                twice = np.zeros(len(at), bool)
                twice[order] = np.repeat(size, size) > 1
                send = ~twice
                send[order[first]] = True
                out = list(pack(ids, ths, words, at[send], bucket_of(b[send], n), (h[send], 8)))
                yield batch_of(out + passed_on(answers(twice, at - words.offsets[owner], owner, ids, ths, n), n), PACKED_ARROW)

    def repeats(group: pa.Table) -> pa.Table:
        group, done = told_apart(group)
        if not len(group):
            return done
        h, place, owner, ids, ths = unpack(group, 8)
        order, _, size = starts_in_group(h)
        twice = np.zeros(len(h), bool)
        twice[order] = np.repeat(size, size) > 1
        return pa.concat_tables([answers(twice, place, owner, ids, ths, n), done])

    extended = texts.join(gathered(anchored), ["doc_id", "th"]).select("doc_id", "th", "text", "places").mapInArrow(windows, PACKED)
    return texts, gathered(extended.groupBy("bucket").applyInArrow(repeats, ANSWERS))


def remove_repeats(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, n_runs, kept: each text's words that no repeated window covers, joined by one space."""
    texts, found = repeated_places(docs, length, block, buckets)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "n_runs", "kept")}
            for t, found in zip(texts, rows["places"].to_pylist(), strict=True):
                words = space_words(t)
                gone = covered(len(words), read_places(found), length) if found else np.zeros(len(words), bool)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["n_runs"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                out["kept"].append(b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x) if found else b" ".join(words))
            yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), *(pa.array(out[k], pa.int64()) for k in ("n_words", "n_removed", "n_runs")), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])

    return texts.join(found, ["doc_id", "th"], "left").select("doc_id", "text", "places").mapInArrow(kept, "doc_id long, n_words long, n_removed long, n_runs long, kept binary")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_runs")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT k.doc_id, count(*) - count(c.i) AS n, string_agg(CASE WHEN c.i IS NULL THEN x END, ' ' ORDER BY k.i) AS kept
  FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.i = c.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(t.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
  coalesce((SELECT count(*) FROM c WHERE c.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM c AS e WHERE e.doc_id = c.doc_id AND e.i = c.i - 1)), 0) AS n_runs
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
