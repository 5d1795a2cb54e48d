"""Embedding near-duplicates by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Vectors are scaled to unit length; at cosine c they are sqrt(2 - 2c) apart. Coarse centroids and the codebooks of the
residuals' subspaces are fitted on a sample of at most SAMPLE vectors (a documented bound: the smallest hashes of
vec_id); every vector is indexed. Lists grow with the table: there are about as many as the square root of its vectors, and so
many at least that a list holds SLICE on average. Up to COARSE they are centroids; beyond, each coarse list is parted by the nearest of a second set of centroids, which is
fitted on the residuals of the sample, so that the sample needn't grow. A vector is encoded once and stored in its nearest list
as the codes of its residual and their error, a byte for each subspace and four. It searches its nearest lists, PROBES of
them and more where lists are parted, with its own components in single precision: table-lookup distances, less the stored
error, are a lower bound of the true distance, so whatever they leave out is no link. Only vectors that are left on either
side of a search are fetched, and compared exactly, in double precision. Tests measure the recall of links against all pairs
at 1,024 lists, at parted ones, and through the whole operator.

Copies (equal vectors of one label) are one class with a count. Lists are cut into slices of at most SLICE vectors and
searches into slices too, so a task holds two slices, however large a list is; it returns, for each vector, its number of
links and, for each component inside the slices, links to its smallest member, never the pairs. A pair is counted where
either of the two finds the other, once.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without label, have
no links and are kept; vectors of different lengths are never compared; vec_id null is left out; rows that repeat a vec_id
with the same vector and label are one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

COSINE = 0.93
SAMPLE = 20_000
PROBES = 12
SUBSPACES = 8
CODES = 64
SLICE = 2048
COARSE = 1024


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of x (rows), started from evenly spaced rows."""
    k = max(1, min(k, len(x)))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    d = (centres**2).sum(axis=1) - 2 * x @ centres.T
    n = min(n, len(centres))
    best = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, axis=1), axis=1, kind="stable"), axis=1)


class Quantiser:
    """Coarse centroids, the second level that parts their lists, and residual codebooks, for vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int, coarse: int = COARSE):
        self.coarse = kmeans(x, min(lists, coarse))
        r = x - self.coarse[nearest(x, self.coarse, 1)[:, 0]]
        self.second = kmeans(r, -(-lists // coarse)) if lists > coarse else np.zeros((1, x.shape[1]))
        r = r - self.second[nearest(r, self.second, 1)[:, 0]]
        self.parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [kmeans(r[:, p], CODES) for p in self.parts]

    def centre(self, at: int | np.ndarray) -> np.ndarray:
        return self.coarse[at // len(self.second)] + self.second[at % len(self.second)]

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each row, nearest first: of the probes nearest coarse ones, the nearest parts."""
        near, k = nearest(x, self.coarse, probes), len(self.second)
        if k == 1:
            return near
        found, apart = [], []
        for c in near.T:
            r = x - self.coarse[c]
            d = (self.second**2).sum(axis=1) - 2 * r @ self.second.T + (r**2).sum(axis=1)[:, None]
            found.append(c[:, None] * k + np.arange(k))
            apart.append(d)
        found, apart = np.concatenate(found, axis=1), np.concatenate(apart, axis=1)
        n = min(found.shape[1], probes * (1 + math.ceil(math.log2(k))))
        best = np.argsort(apart, axis=1, kind="stable")[:, :n]
        # Where a vector is stored doesn't depend on how many lists it searches.
        return np.take_along_axis(found, best, axis=1)

    def encode(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far off they are."""
        codes = np.stack([nearest(r[:, p], b, 1)[:, 0] for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        off = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1) - r
        return codes.astype(np.uint8), np.sqrt((off**2).sum(axis=1))

    def distances(self, r: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distance of each row of r to what each code stands for, from tables."""
        total = np.zeros((len(r), len(codes)), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            look = ((r[:, p][:, None, :] - b[None]) ** 2).sum(axis=2).astype(np.float32)
            total += look[:, codes[:, i]]
        return np.sqrt(total)


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length 1."""
    x = np.array(column.to_pylist(), np.float64)
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, sample: int = SAMPLE, slice_: int = SLICE, coarse: int = COARSE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    spark = vectors.sparkSession
    v = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("x"))
    fit = F.col("label").isNotNull() & (F.coalesce(F.size("x"), F.lit(0)) > 0) & F.coalesce(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("x", lambda e: e != 0), F.lit(False))
    v = v.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = v.where("fit").select("vec_id", "label", "x").distinct()
    classes = cut(good.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies")).withColumn("dim", F.size("x")))

    drawn = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("x").toPandas()["x"]
    n = classes.count()
    lists = max(1, round(math.sqrt(n)), -(-n // slice_))
    byd: dict[int, list] = {}
    for x in drawn:
        byd.setdefault(len(x), []).append(x)
    # Lengths that the sample has missed are rare; their vectors share one list.
    unit = lambda x: x / np.sqrt((x**2).sum(axis=1))[:, None]
    model = spark.sparkContext.broadcast({d: Quantiser(unit(np.array([np.asarray(y, float) for y in x])), min(lists, max(1, len(x) // 4) if len(x) < sample // 2 else lists), coarse) for d, x in byd.items()})

    def known_for(d: int) -> Quantiser:
        return model.value[d] if d in model.value else Quantiser(np.zeros((1, d)), 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's lists, nearest first; the first is where it is stored, as codes."""
        for batch in batches:
            for d in set(batch.column("dim").to_pylist()):
                rows, known = pa.Table.from_batches([batch]).filter(pa.compute.equal(batch.column("dim"), d)), known_for(d)
                x = units(rows["x"])
                near = known.lists(x, probes)
                codes, off = known.encode(x - known.centre(near[:, 0]))
                more = {"u": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), "lists": pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "off": pa.array(off.astype(np.float32))}
                for name, column in more.items():
                    rows = rows.append_column(name, column)
                yield from rows.combine_chunks().to_batches()

    label = classes.schema["label"].dataType.simpleString()
    place = cut(classes.select("rep", "copies", "label", "dim", "x").mapInArrow(placed, f"rep long, copies long, label {label}, dim int, x array<double>, u array<float>, lists array<int>, codes binary, off float"))
    spot = ["label", "dim", "list"]
    stored = place.select("label", "dim", F.element_at("lists", 1).alias("list"), "rep", "codes", "off")
    asking = place.select("label", "dim", F.explode("lists").alias("list"), "rep", "u")
    many = lambda df, name: df.groupBy(*spot).agg(F.ceil(F.count("*") / slice_).cast("int").alias(name))
    cuts = many(stored, "stored_n").join(many(asking, "asking_n"), spot)
    key = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    stored = stored.join(cuts, spot).select(*spot, "rep", "codes", "off", key("stored_n").alias("s"), F.explode(F.sequence(F.lit(0), F.col("asking_n") - 1)).alias("q"))
    asking = asking.join(cuts, spot).select(*spot, "rep", "u", key("asking_n").alias("q"), F.explode(F.sequence(F.lit(0), F.col("stored_n") - 1)).alias("s"))
    apart = math.sqrt(2 - 2 * cosine)
    unit_of_work = [*spot, "s", "q"]

    def possible(rows: pa.Table) -> pa.Table:
        """Of a search, the vectors on either side that the bound leaves a partner."""
        q, s = rows.filter(rows["asks"]), rows.filter(pa.compute.invert(rows["asks"]))
        out = {"asks": [], "rep": []}
        if len(q) and len(s):
            known = known_for(q["dim"][0].as_py())
            u, own = np.array(q["u"].to_pylist()), (q["rep"].to_numpy(), s["rep"].to_numpy())
            codes = np.frombuffer(b"".join(s["codes"].to_pylist()), np.uint8).reshape(len(s), -1)
            near = known.distances(u - known.centre(q["list"][0].as_py()), codes) <= apart + s["off"].to_numpy() + 1e-3
            near &= own[0][:, None] != own[1]
            left = [x[near.any(axis=1 - k)] for k, x in enumerate(own)]
            out = {"asks": [True] * len(left[0]) + [False] * len(left[1]), "rep": np.concatenate(left)}
        at = {k: pa.array([rows[k][0].as_py()] * len(out["rep"]), rows.schema.field(k).type) for k in unit_of_work}
        return pa.table({**at, "asks": pa.array(out["asks"], pa.bool_()), "rep": pa.array(out["rep"], pa.int64())})

    def search(unit_rows: pa.Table) -> pa.Table:
        q, s = unit_rows.filter(unit_rows["asks"]), unit_rows.filter(pa.compute.invert(unit_rows["asks"]))
        none = pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if not len(q) or not len(s):
            return none
        known = known_for(q["dim"][0].as_py())
        xq, xs = units(q["x"]), units(s["x"])
        a, b = np.nonzero(xq @ xs.T >= cosine - 1e-9)
        q_id, s_id = q["rep"].to_numpy(), s["rep"].to_numpy()
        keep = q_id[a] != s_id[b]
        a, b = a[keep], b[keep]
        cos = np.concatenate([(xq[a[i : i + 100_000]] * xs[b[i : i + 100_000]]).sum(axis=1) for i in range(0, len(a), 100_000)]) if len(a) else np.zeros(0)
        a, b = a[cos >= cosine], b[cos >= cosine]
        if not len(a):
            return none
        home = np.array([x[0] for x in q["lists"].to_pylist()])
        asked = s["lists"].to_pylist()
        every = len(known.coarse) * len(known.second)
        seen = np.repeat(np.arange(len(s_id)), [len(x) for x in asked]) * every + np.concatenate(asked)
        back = ~np.isin(b * every + home[a], seen)  # the stored vector doesn't find the one that asks: its link is counted here
        n_q = np.bincount(a, s["copies"].to_numpy()[b], len(q_id))
        n_s = np.bincount(b[back], q["copies"].to_numpy()[a[back]], len(s_id))
        ids, where = np.unique(np.concatenate([q_id, s_id]), return_inverse=True)
        low = np.arange(len(ids))
        wa, wb = where[: len(q_id)][a], where[len(q_id) :][b]
        while True:
            was = low.copy()
            m = np.minimum(low[wa], low[wb])
            np.minimum.at(low, wa, m)
            np.minimum.at(low, wb, m)
            low = low[low]
            if (low == was).all():
                break
        links = np.bincount(where[: len(q_id)], n_q, len(ids)) + np.bincount(where[len(q_id) :], n_s, len(ids))
        used = np.unique(np.concatenate([wa, wb]))
        return pa.table({"rep": pa.array(ids[used]), "links": pa.array(links[used].astype(np.int64)), "to": pa.array(ids[low[used]])})

    met = asking.withColumn("asks", F.lit(True)).unionByName(stored.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    left = met.groupBy(*unit_of_work).applyInArrow(possible, f"label {label}, dim int, list int, s int, q int, asks boolean, rep long")
    both = left.join(place.select("rep", "copies", "lists", "x"), "rep")
    found = cut(both.groupBy(*unit_of_work).applyInArrow(search, "rep long, links long, to long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")).distinct())
    of = classes.join(linked, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left").select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return v.where("fit").join(of, ["label", "x"]).select("vec_id", "n_links", "component_id").unionByName(v.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, label IS NOT NULL AND coalesce(len(embedding), 0) > 0 AND coalesce(len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0, false)
    AND coalesce(list_sum(list_transform(embedding, lambda e: abs(e))) > 0, false) AS fit FROM embeddings WHERE vec_id IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.fit AND b.fit AND list_cosine_similarity(a.x, b.x) >= 0.93
), r(vec_id, component_id) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.component_id FROM r JOIN l ON l.a = r.vec_id WHERE r.component_id < l.b
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, (SELECT min(component_id) FROM r WHERE r.vec_id = v.vec_id) AS component_id,
  v.vec_id = (SELECT min(component_id) FROM r WHERE r.vec_id = v.vec_id) AS kept FROM v
"""
