"""Timelines, signals, tokens and run tables projected from the driver's tables, and the same projections in SQL.

Frames are numbered by event within a user; recordings are days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, rec (yyyymmdd), start_ms since midnight."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.date_format("ts", "yyyyMMdd").cast("long").alias("rec"), F.floor(us % (DAY_MS * 1000) / 1000).cast("long").alias("start_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("turn_id"), "rec", "user_id", F.concat(F.lit("speaker_"), (F.col("user_id") % 4).cast("string")).alias("speaker"), "start_ms",
        (F.col("start_ms") + F.round(F.col("value") * 10000).cast("long")).alias("end_ms"), ((F.col("user_id") % 10 + 1) / 10).alias("conf"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type").isin("click", "view"))
    return e.select(F.col("event_id").alias("word_id"), "rec", F.col("event_type").alias("text"), "start_ms", (F.col("start_ms") + 30000).alias("end_ms"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day with a whole day's length."""
    return events(spark, sf_dir).select("rec").distinct().withColumn("total_ms", F.lit(DAY_MS).cast("long"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec (user), frame, x and prob of the user's events in order."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return events(spark, sf_dir).select(F.col("user_id").alias("rec"), nth.cast("long").alias("frame"), (F.col("value") / 500).alias("x"), F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


def blocks(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """The same signal as blocks: rec, block_idx, start_frame, samples."""
    x = frames(spark, sf_dir).withColumn("block_idx", F.floor(F.col("frame") / size))
    return x.groupBy("rec", "block_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "x"))), lambda s: s["x"]).alias("samples")).withColumn("start_frame", F.col("block_idx") * size)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of up to three characters of the benchmark's items, 80 ms each."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rec"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[ \n\t]?[^ \n\t]{1,3}"), F.lit(0))).alias("idx", "token"))
    return b.select("rec", "idx", "token", (F.col("idx") * 80).cast("long").alias("start_ms"), (F.col("idx") * 80 + 80).cast("long").alias("end_ms"), ((F.col("idx") % 10 + 1) / 10).alias("confidence"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, embedding in doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def voices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of the vectors, one in twenty as references and the others as voices."""
    e = vectors(spark, sf_dir)
    return e.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "voice_id"), e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "ref_id")


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 10).cast("string")).alias("case_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"), F.col("l_quantity").alias("seconds"), F.lit(30.0).alias("audio_seconds"), F.col("l_extendedprice").alias("memory"), "l_shipdate")


#: The projections above as common table expressions.
SQL = {
    "ev": "ev AS (SELECT event_id, user_id, event_type, value, ts, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS rec, CAST((epoch_us(ts) % 86400000000) // 1000 AS BIGINT) AS start_ms FROM events)",
    "turns": "turns AS (SELECT event_id AS turn_id, rec, user_id, 'speaker_' || (user_id % 4) AS speaker, start_ms, start_ms + CAST(round(value * 10000) AS BIGINT) AS end_ms, (user_id % 10 + 1) / 10.0::DOUBLE AS conf FROM ev)",
    "words": "words AS (SELECT event_id AS word_id, rec, event_type AS text, start_ms, start_ms + 30000 AS end_ms FROM ev WHERE event_type IN ('click', 'view'))",
    "recordings": "recordings AS (SELECT DISTINCT rec, 86400000::BIGINT AS total_ms FROM ev)",
    "frames": "frames AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 500 AS x, least(1.0::DOUBLE, value / 100) AS prob FROM ev)",
    "tokens": r"""tokens AS (SELECT item_id AS rec, i - 1 AS idx, t[i] AS token, (i - 1) * 80 AS start_ms, i * 80 AS end_ms, ((i - 1) % 10 + 1) / 10.0::DOUBLE AS confidence
  FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[ \n\t]?[^ \n\t]{1,3}') AS t FROM benchmark)))""",
    "voices": "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), voices AS (SELECT vec_id AS voice_id, label, embedding FROM vecs WHERE vec_id % 20 <> 0), refs AS (SELECT vec_id AS ref_id, label, embedding FROM vecs WHERE vec_id % 20 = 0)",
    "runs": "runs AS (SELECT l_returnflag || l_linestatus || (l_suppkey % 10) AS case_id, l_orderkey || '-' || l_linenumber AS run_id, l_quantity AS seconds, 30.0::DOUBLE AS audio_seconds, l_extendedprice AS memory, l_shipdate FROM lineitem)",
}


def using(*names: str) -> str:
    """WITH and the named projections, each after what it needs."""
    needs = {"turns": ["ev"], "words": ["ev"], "recordings": ["ev"], "frames": ["ev"]}
    order: list[str] = []
    for n in names:
        order += [x for x in [*needs.get(n, []), n] if x not in order]
    return "WITH " + ", ".join(SQL[n] for n in order)
