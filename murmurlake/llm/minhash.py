"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds its distinct shingles of `width` words. A sketch has COORDINATES coordinates: in each round every
shingle is thrown into one bin, and a bin that was still empty keeps the smallest value of the round; after as many rounds
as there are bins, the round's number names the bin, so that every coordinate is sure to be filled. Coordinates agree
with the probability of the sets' similarity and concentrate like independent ones, at about one round for long texts.

Bands of ROWS coordinates make candidates: two sets of similarity 0.85 share none of the BANDS bands once in a million, of 0.8 seven
times in 100,000.
Documents with equal sets are one class from the start, with the smallest doc_id standing for it. In a bucket of a band,
each member is verified against the bucket's smallest member, on full sets; then, where a bucket still holds several
components, every member outside its largest one is compared with all members of other components. So every pair of a
bucket is either verified or known to be linked, and a bucket of thousands of copies costs one comparison for each.
Before full sets are fetched, sizes are compared, and then the sets' parities in PARITIES bins: an element of one set only
flips its bin, so the parities that differ are a lower bound of the elements that differ, and no link is lost there.
A set that many pairs need is cut into as many copies as tasks share its pairs, so a large cluster's first member isn't hot.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer words than that are one
shingle; repeated rows are one node; a doc_id that comes with several texts is one node with the links of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, components, cut, documents, factors, lower_space_words, mix, table, window_hashes

BANDS = 24
ROWS = 5
COORDINATES = BANDS * ROWS
PARITIES = 2048
#: Pairs of one set that are verified in one place.
SLICE = 500
SEED = 8


def shingle_sets(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    words = Words([lower_space_words(t) for t in texts])
    x = words.hashes(SEED)
    full = window_hashes(x, width, SEED)
    out = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        else:
            out.append(window_hashes(x[a:b], int(b - a), SEED + int(b - a)) if b > a else x[:0])
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """A row of t coordinates for each set; empty sets have zeros."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(n * t, bool)
    filled.reshape(n, t)[sizes == 0] = True
    elements = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    salt = factors(2 * t, SEED)
    for r in range(2 * t):
        open_ = ~filled.reshape(n, t).all(axis=1)
        if not open_.any():
            break
        mine = open_[owner]
        elements, owner = elements[mine], owner[mine]
        x = mix(elements ^ salt[r])
        slot = owner * t + (((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if r < t else owner * t + (r - t)
        new = ~filled[slot]
        np.minimum.at(out, slot[new], mix(x[new] + salt[r]))
        filled[slot[new]] = True
    out = out.reshape(n, t)
    out[sizes == 0] = 0
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, whether each bin has an odd number of its elements, as longs."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bins = (mix(np.concatenate(sets)) % np.uint64(PARITIES)).astype(np.int64) if len(owner) else owner
    odd = np.bincount(owner * PARITIES + bins, minlength=len(sets) * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), PARITIES), axis=1).view("<i8")


SIGNATURE = "doc_id long, n long, s1 long, s2 long, bands array<long>, odd array<long>"


def signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches):
        sets = shingle_sets(texts, width)
        coordinates = sketches(sets)
        with np.errstate(over="ignore"):
            bands = mix((coordinates.reshape(len(sets), BANDS, ROWS) * factors(ROWS, SEED)).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
        ids = [identity(s) for s in sets]
        odd = parities(sets)
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), BANDS).cast(pa.list_(pa.int64())), pa.FixedSizeListArray.from_arrays(pa.array(odd.reshape(-1)), PARITIES // 64).cast(pa.list_(pa.int64()))],
            names=["doc_id", "n", "s1", "s2", "bands", "odd"],
        )


def full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), pa.array([s.astype(np.int64) for s in shingle_sets(texts, width)], pa.list_(pa.int64()))], names=["node", "shingles"])


def verified(docs: DataFrame, pairs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Pairs of one a are dealt to slices of SLICE, each with its copy of a's set."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = cut(docs.select("doc_id", "text").join(needed, "doc_id", "left_semi").mapInArrow(lambda b: full_sets(b, width), "node long, shingles array<long>"))
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    dealt = pairs.join(slices, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int").alias("slice"))
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(slices, "a").select("a", "sa", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    x = dealt.join(sa, ["a", "slice"]).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return x.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; documents of a component are linked by similarity of percent or more."""
    docs = documents(docs)
    signed = cut(docs.mapInArrow(lambda b: signatures(b, width), SIGNATURE))
    what = ("odd",)
    classes = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "bands", *what)).alias("x"))
    classes = cut(classes.select("s1", "s2", "n", F.col("x.doc_id").alias("rep"), "x.bands", *(f"x.{k}" for k in what)))
    node = classes.select("rep", "n", *what)
    spot = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    member = cut(spot.join(spot.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1").drop("size"), ["band", "value"]))

    def close(a: str, b: str):
        """Sizes and parities allow the similarity."""
        flips = F.aggregate(F.zip_with(F.col(f"{a}.odd"), F.col(f"{b}.odd"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = F.col(f"{a}.n") + F.col(f"{b}.n")
        return (F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent) & (F.col(f"{b}.n") * 100 >= F.col(f"{a}.n") * percent) & (flips * (100 + percent) <= both * (100 - percent))

    star = member.where("rep <> pivot").select("rep", "pivot").distinct().join(node, "rep").alias("m").join(node.alias("p"), F.col("m.pivot") == F.col("p.rep"))
    links = cut(verified(docs, cut(star.where(close("m", "p")).select(F.col("m.pivot").alias("a"), F.col("m.rep").alias("b"))), percent, width))
    found = components(links)
    placed = member.drop("pivot").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    shares = placed.groupBy("band", "value", "component").agg(F.count("*").alias("share"))
    mixed = shares.groupBy("band", "value").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("share", "component")).alias("largest")).where("parts > 1").drop("parts")
    placed = cut(placed.join(mixed, ["band", "value"]).join(node, "rep"))
    outside = placed.where("component <> largest")
    cross = outside.alias("o").join(placed.alias("m"), ["band", "value"]).where((F.col("o.component") != F.col("m.component")) & ((F.col("m.component") == F.col("m.largest")) | (F.col("o.rep") < F.col("m.rep"))) & close("o", "m"))
    cross = cut(cross.select(F.least("o.rep", "m.rep").alias("a"), F.greatest("o.rep", "m.rep").alias("b")).distinct().join(links, ["a", "b"], "left_anti"))
    if not cross.isEmpty():
        # What is linked already is a star around its smallest member, and stays linked.
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(docs, cross, percent, width)))
    of = classes.select("s1", "s2", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    return signed.join(of, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85, 3).withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
), s AS (SELECT DISTINCT doc_id, md5_number(s) AS h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, component_id) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.component_id FROM r JOIN l ON l.a = r.doc_id WHERE r.component_id < l.b
), m AS (SELECT doc_id, min(component_id) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
