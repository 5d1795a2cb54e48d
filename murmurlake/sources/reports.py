"""Benchmark reports, voice tables, and timelines as CSV, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIMING = "struct<loadSeconds:string,firstRunSeconds:string,iterationSeconds:array<string>,minSeconds:string,medianSeconds:string,meanSeconds:string,stdDevSeconds:string,realTimeFactor:string,realTimeFactorBest:string>"
_MEMORY = "struct<baselineFootprintBytes:bigint,afterLoadFootprintBytes:bigint,peakFootprintBytes:bigint,peakResidentBytes:bigint,mlxActiveAfterLoadBytes:bigint,mlxPeakDuringRunBytes:bigint,weightsMaterializedAtLoad:boolean>"
_CPU = "struct<userSeconds:string,systemSeconds:string,wallSeconds:string>"
_PLACE = "struct<thermalStateAtStart:string,thermalStateAtEnd:string,lowPowerModeEnabled:boolean,powerSource:string>"
_CONFIG = "struct<iterations:int,warmupIterations:int,inputSeconds:string,inputSource:string,isolation:string,cooldownSeconds:string,buildConfiguration:string>"
_CASE = f"struct<id:string,label:string,category:string,backend:string,status:string,message:string,inputSampleRate:int,inputFrames:bigint,outputStreams:int,outputFrames:bigint,outputSampleRate:int,weightsSource:string,timing:{_TIMING},memory:{_MEMORY},cpu:{_CPU},environment:{_PLACE}>"
REPORT = f"runID string, tag string, startedAt string, finishedAt string, configuration {_CONFIG}, results array<{_CASE}>"


def number(text: Column) -> Column:
    """A number, or nan, inf, -inf as words."""
    low = F.lower(F.trim(text))
    return F.when(low == "nan", float("nan")).when(low == "inf", float("inf")).when(low == "-inf", float("-inf")).otherwise(low.try_cast("double"))


def bench_cases(reports: DataFrame) -> DataFrame:
    """A row for each case of each report (REPORT), with what timing, memory, CPU and quality figures are made from as numbers."""
    x = reports.select("runID", "tag", F.to_timestamp("finishedAt").alias("finished_at"), "configuration", F.explode("results").alias("r"))
    memory = {"before_load": "baselineFootprintBytes", "after_load": "afterLoadFootprintBytes", "active_bytes": "mlxActiveAfterLoadBytes", "peak_bytes": "mlxPeakDuringRunBytes", "materialized": "weightsMaterializedAtLoad"}
    cpu = {"user_s": "userSeconds", "system_s": "systemSeconds", "wall_s": "wallSeconds"}
    return x.select(
        "runID", "tag", "finished_at", F.col("r.id").alias("case_id"), "r.label", "r.category", "r.backend", "r.status", "r.message", "r.inputSampleRate", "r.inputFrames",
        F.transform("r.timing.iterationSeconds", number).alias("seconds"), number(F.col("r.timing.stdDevSeconds")).alias("sd_s"), (F.col("r.inputFrames") / F.col("r.inputSampleRate")).alias("audio_seconds"),
        *(F.col(f"r.memory.{c}").alias(n) for n, c in memory.items()), *(number(F.col(f"r.cpu.{c}")).alias(n) for n, c in cpu.items()),
        (F.col("r.environment.powerSource") == "battery").alias("on_battery"), F.col("r.environment.lowPowerModeEnabled").alias("low_power"), F.col("r.environment.thermalStateAtStart").alias("thermal_before"), F.col("r.environment.thermalStateAtEnd").alias("thermal_after"),
        (F.col("r.weightsSource") == "network").alias("cold"), F.col("configuration.buildConfiguration").alias("build"), (F.col("configuration.isolation") == "process").alias("isolated"),
    )


def read_bench_reports(spark: SparkSession, path: str, a_line_each: bool = False) -> DataFrame:
    """Cases of the reports under path: a file each, or a line each."""
    return bench_cases(spark.read.schema(REPORT).option("multiLine", not a_line_each).json(path))


def read_voices(spark: SparkSession, path: str, a_line_each: bool = False, calibration: bool = False) -> DataFrame:
    """voice_id, embedding of a table's voices, and its calibration text if asked for; a table whose counts or dimensions don't agree gives an error row."""
    x = spark.read.schema("voiceIds array<string>, embeddings array<array<double>>, calibrationText string").option("multiLine", not a_line_each).json(path)
    dims = F.array_distinct(F.transform("embeddings", lambda e: F.size(e)))
    bad = F.when(F.size("voiceIds") != F.size("embeddings"), "counts differ").when(F.size(dims) > 1, "dimensions differ")
    x = x.withColumn("error", bad)
    more = [F.col("calibrationText").alias("calibration")] if calibration else []
    good = x.where("error IS NULL").select(F.explode(F.arrays_zip("voiceIds", "embeddings")).alias("z"), "calibrationText").select(F.col("z.voiceIds").alias("voice_id"), F.col("z.embeddings").alias("embedding"), F.lit(None).cast("string").alias("error"), *more)
    return good.unionByName(x.where("error IS NOT NULL").select(F.lit(None).cast("string").alias("voice_id"), F.lit(None).cast("array<double>").alias("embedding"), "error", *more))


def write_voices(voices: DataFrame, path: str, table: str = "voice_table", calibration: str = "") -> None:
    """Tables (voiceIds, embeddings, calibrationText) that read_voices reads: one for each value of `table`, all voices in one where there is no such column."""
    x = voices if table in voices.columns else voices.withColumn(table, F.lit(0))
    g = x.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("voice_id", "embedding"))).alias("v"))
    g.select(F.transform("v", lambda s: s["voice_id"].cast("string")).alias("voiceIds"), F.transform("v", lambda s: s["embedding"]).alias("embeddings"), F.lit(calibration).alias("calibrationText")).write.mode("overwrite").json(path)


def turns_csv(turns: DataFrame) -> DataFrame:
    sec = lambda c: F.format_string("%.3f", F.col(c) / 1000)
    return turns.select(sec("start_ms").alias("start"), sec("end_ms").alias("end"), "speaker", F.format_string("%.3f", F.col("conf")).alias("confidence"))


def words_csv(words: DataFrame) -> DataFrame:
    sec = lambda c: F.format_string("%.3f", F.col(c) / 1000)
    return words.select(sec("start_ms").alias("start"), sec("end_ms").alias("end"), F.coalesce("speaker", F.lit("")).alias("speaker"), "text")


def write_turns_csv(turns: DataFrame, path: str) -> None:
    turns_csv(turns.orderBy("rec", "start_ms", "end_ms")).write.mode("overwrite").option("header", True).csv(path)


def write_words_csv(words: DataFrame, path: str) -> None:
    words_csv(words.orderBy("rec", "start_ms", "end_ms")).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def transcript_line(start_ms: Column, speaker: Column, text: Column) -> Column:
    """[MM:SS.ss] Speaker X: text"""
    return F.format_string("[%02d:%05.2f] Speaker %s: %s", F.floor(start_ms / 60000), (start_ms % 60000) / 1000, F.coalesce(speaker, F.lit("Unknown")), text)


def render_transcript(words: DataFrame) -> DataFrame:
    """rec, text: a recording's lines in order. A transcript is one row by nature."""
    line = transcript_line(F.col("start_ms"), F.col("speaker"), F.col("text"))
    return words.groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "word_id", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))


def segment_manifest(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """rec, json: source, total duration and segments in order."""
    s = F.struct((F.col("start_ms") / 1000).alias("originalStart"), (F.col("end_ms") / 1000).alias("originalEnd"), "file", "type", ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("durationSeconds"))
    g = segments.groupBy("rec").agg(F.array_sort(F.collect_list(s)).alias("segments")).join(recordings, "rec")
    return g.select("rec", F.to_json(F.struct(F.col("rec").cast("string").alias("sourceFile"), (F.col("total_ms") / 1000).alias("totalDuration"), "segments")).alias("json"))
