"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / quality, where u comes from the md5 of its id, so that reruns agree.
Within a source, smaller keys come first. A source takes whole epochs of all its documents, then documents in key order
until its word budget is met; the document at the edge gives the words that are left.

The prefix sums never gather a source in one task: each source is cut into slices of the key, one for IN_SLICE rows of the whole
table, the sums of the slices are added up, and only a slice is sorted. Slices follow the distribution of a key of LEAST
quality: at quality q a slice's share of the rows is q / LEAST of the mean at most, so none holds over 1 / LEAST times as many,
however many slices there are.
The one table that is sorted in a single task has a row for each source.

Defined results: null text has size 0; a null source is a source of its own and comes last; without words all targets
are 0; repeated rows count as often as they occur; documents without words take nothing; texts of any length are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Rows of the whole table to a slice of the keys, and slices of a source at least.
IN_SLICE, SLICES = 10_000, 64
#: The least quality of a document.
LEAST = 0.25


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """0.25 to 1: how near the characters a word, white space included, are to 6.5."""
    return F.greatest(F.lit(LEAST), F.lit(1.0) - F.abs(F.coalesce(F.length(text), F.lit(0)) / F.greatest(size, F.lit(1)) - F.lit(6.5)) / F.lit(13.0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with weight and target.

    A target is min(most * size, level * weight) with the level at which all targets sum to share * all sizes. The sum is
    concave in the level, so the level is the largest of the levels that each number of full sources would give.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    x = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full, used = F.coalesce(F.sum("cap").over(by), F.lit(0.0)), F.coalesce(F.sum("weight").over(by), F.lit(0.0))
    x = x.withColumn("level_k", (F.sum("source_size").over(every) * F.lit(share) - full) / (F.sum("weight").over(every) - used))
    return x.withColumn("target", F.least("cap", F.max("level_k").over(every) * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, source, size, quality, source_size, target, taken for each document, and the columns named in keep.

    Texts are cut into words once: what follows reads the sizes and keys that were written.
    """
    size = size_of(F.col("text"))
    u = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    rows = cut(
        docs.where("doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"), "text")
        .withColumn("quality", quality_of(F.col("text"), F.col("size")))
        .withColumn("key", -F.log(u) / F.col("quality"))
        .select("doc_id", "source", "size", "quality", "key", "kept", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("skey"))
    )
    slices = max(SLICES, -(-rows.count() // IN_SLICE))
    rows = rows.withColumn("slice", F.least(F.lit(slices - 1), F.floor((F.lit(1.0) - F.exp(F.lit(-LEAST) * F.col("key"))) * slices)).cast("int"))
    sums = cut(rows.groupBy("skey", "slice").agg(F.sum("size").alias("words"), F.first("source").alias("source")))
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    goal = goal.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source", "weight")
    before = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select("skey", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("earlier")).join(goal, "skey")
    inside = Window.partitionBy("skey", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(known, ["skey", "slice"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.floor("target") - epochs * F.col("source_size"))
    taken = epochs * F.col("size") + F.least("size", F.greatest(F.lit(0), rest - F.col("earlier") - F.col("prior")))
    return x.select("doc_id", "source", "size", "quality", "source_size", "target", taken.cast("long").alias("taken"), *([f"kept.{c}" for c in keep if c not in ("doc_id", "source")]))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), 0) AS chars,
    (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents WHERE doc_id IS NOT NULL
), k AS (
  SELECT doc_id, source, size, -ln(u) / greatest(0.25::DOUBLE, 1.0::DOUBLE - abs(CAST(chars AS DOUBLE) / greatest(size, 1) - 6.5::DOUBLE) / 13.0::DOUBLE) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w
  FROM k GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level_k
  FROM s WINDOW p AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(level_k) OVER () * w) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
)
SELECT k.doc_id, k.size, e.source_size, e.target,
  CAST(epochs * size + least(size, greatest(0, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size)
    - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
