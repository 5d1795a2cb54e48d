"""Line deduplication with a log-template tree of fixed depth.

A line's leaf in the tree is its number of words and its first DEPTH words, with words that hold a digit as variable
fields. A leaf holds several templates: its most frequent line (with digits generalised) is the first, and takes the lines
that agree with it in at least SIMILAR of the words after the leading ones, whatever fields differ; the most frequent line
that is left is the next, until none is left (ties: the line that stands first, by doc_id and place). A template that
occurs in at least `min_texts` different texts is recurring: its lines stay in the document with the smallest doc_id among
those that have it and are dropped everywhere else. Copies of a document count as one text, so copying a document does
not make its lines boilerplate.

Leaves, lines and templates are counted with sums made before each shuffle; leaves that stand in fewer rows than a template
needs drop out at once. Templates are found on different lines, in buckets of leaves.

Defined results: null text stays null and has no lines; lines of fewer than `min_words` words, which are often too short to
tell boilerplate from speech, are never dropped; a text whose lines all go is empty, and its document stays; repeated rows
are treated alike; texts and lines of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buckets_for, chunks, cut, documents, factors, mix, space_words, table, text_bytes, text_hash

DEPTH = 3
SIMILAR = 0.7
MIN_TEXTS = 2
MIN_WORDS = 3
SEED = 3
_FIELD = np.uint64(0xA5A5A5A5A5A5A5A5)


def line_rows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """A row for each line that is long enough: its leaf, itself with fields generalised, and two bytes for each word after the leading ones."""
    for rows, texts in chunks(batches):
        split = [t.split(b"\n") for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        number = np.concatenate([np.arange(len(x)) for x in split])
        words = Words([space_words(line) for x in split for line in x])
        if not words.total:
            continue
        h = words.hashes(SEED)
        digit = (words.buffer >= 48) & (words.buffer <= 57)
        h[np.add.reduceat(digit.astype(np.int64), words.starts) > 0] = _FIELD
        place = np.arange(words.total) - words.offsets[words.owner]
        with np.errstate(over="ignore"):
            value = h * factors(int(words.counts.max()), SEED)[place]
            long_ = np.flatnonzero(words.counts >= min_words)
            start = words.offsets[long_]
            has = words.counts > 0
            whole = np.zeros(len(words.counts), np.uint64)
            whole[has] = np.add.reduceat(value, words.offsets[:-1][has])
            leaf = words.counts[long_].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for d in range(DEPTH):
                there = words.counts[long_] > d
                leaf[there] = mix(leaf[there] + h[start[there] + d] * factors(DEPTH, SEED)[d])
        each = (h >> np.uint64(40)).astype("<u2").tobytes()
        sign = [each[2 * a + 2 * DEPTH : 2 * b] for a, b in zip(start.tolist(), words.offsets[long_ + 1].tolist(), strict=True)]
        own = of[long_]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["doc_id"].to_numpy()[own]), pa.array(rows["th"].to_numpy()[own]), pa.array(number[long_].astype(np.int32)), pa.array(leaf.astype(np.int64)), pa.array(mix(whole[long_]).astype(np.int64)), pa.array(sign, pa.binary())],
            names=["doc_id", "th", "line", "leaf", "whole", "sign"],
        )


#: Different lines of a leaf from which on they are looked up by parts, and parts at most.
MANY, MOST_PARTS = 200, 64


def first_alike(lines: np.ndarray) -> np.ndarray:
    """For each row the template that takes it: the first row that no earlier template has taken, and that it agrees with in SIMILAR of the places.

    Rows that differ in d places at most agree wholly in one of d + 1 parts of their places at least. So where there are many,
    a template is compared with the rows that share a part with it, not with all that are left.
    """
    n, width = lines.shape
    of = np.arange(n)
    parts = np.array_split(np.arange(width), 1 + width - next(k for k in range(width + 1) if k >= SIMILAR * width))
    if n <= MANY or not width or len(parts) > MOST_PARTS:
        left, rest = of.copy(), lines
        while len(left):
            alike = (rest == rest[0]).sum(axis=1) >= SIMILAR * width
            of[left[alike]] = left[0]
            left, rest = left[~alike], rest[~alike]
        return of
    shared: list[tuple[np.ndarray, dict[int, np.ndarray]]] = []
    for p in parts:
        with np.errstate(over="ignore"):
            key = mix(((lines[:, p].astype(np.uint64) + np.uint64(1)) * factors(len(p), SEED)).sum(axis=1, dtype=np.uint64))
        _, key = np.unique(key, return_inverse=True)
        order = np.argsort(key, kind="stable")
        shared.append((key, dict(enumerate(np.split(order, np.flatnonzero(np.diff(key[order])) + 1)))))
    free = np.ones(n, bool)
    for i in range(n):
        if not free[i]:
            continue
        near = []
        for key, rows in shared:
            own = rows[key[i]]
            rows[key[i]] = own = own[free[own]]  # what has been taken isn't looked at again
            near.append(own)
        near = np.unique(np.concatenate(near))
        near = near[(lines[near] == lines[i]).sum(axis=1) >= SIMILAR * width]
        of[near], free[near] = i, False
    return of


def templates(group: pa.Table) -> pa.Table:
    """The template of each different line of a bucket of leaves."""
    leaf, whole, n, doc, line = (group[c].to_numpy() for c in ("leaf", "whole", "n", "doc_id", "line"))
    sign = group["sign"].to_pylist()
    size = np.fromiter(map(len, sign), np.int64, len(sign))
    order = np.lexsort((whole, line, doc, -n, size, leaf))
    leaf, whole, size, sign = leaf[order], whole[order], size[order], [sign[i] for i in order.tolist()]
    of = np.arange(len(order))
    first = np.flatnonzero((np.diff(leaf, prepend=leaf[0] - 1) != 0) | (np.diff(size, prepend=-1) != 0))
    ends = np.append(first[1:], len(order))
    for a, b in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist(), strict=True):
        of[a:b] = a + first_alike(np.frombuffer(b"".join(sign[a:b]), "<u2").reshape(b - a, -1))
    with np.errstate(over="ignore"):
        template = mix(leaf.astype(np.uint64) + mix(whole.astype(np.uint64)[of])).astype(np.int64)
    return pa.table({"leaf": pa.array(leaf), "whole": pa.array(whole), "template": pa.array(template)})


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, line, template of all lines to be dropped. docs: documents()."""
    lines = cut(docs.mapInArrow(lambda it: line_rows(it, max(1, min_words)), "doc_id long, th long, line int, leaf long, whole long, sign binary"))
    often = lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select("leaf")
    different = lines.join(often, "leaf", "left_semi").groupBy("leaf", "whole").agg(F.first("sign").alias("sign"), F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first")).select("leaf", "whole", "sign", "n", "first.*")
    buckets = buckets_for(text_bytes(docs))
    template = different.groupBy(F.pmod(F.col("leaf"), F.lit(buckets)).alias("bucket")).applyInArrow(templates, "leaf long, whole long, template long")
    placed = lines.select("doc_id", "th", "line", "leaf", "whole").join(template, ["leaf", "whole"]).select("doc_id", "th", "line", "template")
    texts = placed.groupBy("template", "th").agg(F.min("doc_id").alias("doc_id")).groupBy("template").agg(F.count("*").alias("texts"), F.min("doc_id").alias("first_doc")).where(F.col("texts") >= min_texts)
    return placed.join(texts, "template").where("doc_id <> first_doc").select("doc_id", "th", "line", "template")


def dedup_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, min_words: int = MIN_WORDS, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with recurring lines gone from text; all other columns as they are, and the numbers of lines and of dropped ones under the names in counts.

    Columns of docs that have one of these names give way; with counts=None nothing is added.
    """
    dropped = recurring_lines(documents(docs), min_texts, min_words).groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone"))
    # The caller's columns are inside a struct, so none can clash with the ones used here.
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text").cast("string")).alias("th"))
    x = rows.join(dropped, ["doc_id", "th"], "left")
    own = lambda c: F.col("row").getField(c)
    lines: Column = F.split(own("text"), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = F.when(F.col("gone").isNull(), own("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    more = {} if counts is None else {counts[0]: F.when(own("text").isNotNull(), F.size(lines)).otherwise(0).cast("long"), counts[1]: F.coalesce(F.array_size("gone"), F.lit(0)).cast("long")}
    return x.select(*[(text if c == "text" else own(c)).alias(c) for c in docs.columns if c not in more], *[v.alias(k) for k, v in more.items()])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
