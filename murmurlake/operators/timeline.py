"""Timelines of turns (rec, speaker, start_ms, end_ms, conf) and words: sweeps, gaps, attribution, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import interval_join, interval_totals, route_model, slot_of
from ..functions.windows import islands, running, shard_of

HOUR = 3_600_000


def sort_timeline(turns: DataFrame) -> DataFrame:
    return turns.orderBy("rec", "start_ms", "end_ms", "turn_id")


def for_speaker(turns: DataFrame, speaker: str) -> DataFrame:
    return turns.where(F.col("speaker") == speaker)


def speech(vad: DataFrame, is_speech: bool = True) -> DataFrame:
    return vad.where(F.col("is_speech") == is_speech)


def valid_segments(words: DataFrame) -> DataFrame:
    """Without blank text, and with finite, non-negative start and duration (seconds)."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return words.where((F.trim("text") != "") & finite("start") & finite("duration") & (F.col("start") >= 0) & (F.col("duration") >= 0))


def confident(df: DataFrame, threshold: float, column: str = "conf") -> DataFrame:
    return df.where(F.col(column) >= threshold)


def speaker_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("rec").agg(F.count_distinct("speaker").alias("n"))


def concurrency(turns: DataFrame, shard: int = HOUR) -> DataFrame:
    """rec, start_ms, end_ms, n: how many different speakers talk between two consecutive changes.

    Each speaker's turns are merged first, so that nested or repeated turns count once; all changes at one time apply
    together; turns of no length change nothing.
    """
    x = islands(turns.where("end_ms > start_ms"), ["rec", "speaker"], "start_ms", "end_ms", ["end_ms"], shard_of("start_ms", shard))
    merged = x.groupBy("rec", "speaker", "island").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    change = merged.select("rec", F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    net = change.groupBy("rec", F.col("x.t").alias("start_ms")).agg(F.sum("x.d").alias("d"))
    counted = running(net, ["rec"], ["start_ms"], shard_of("start_ms", shard), {"n": ("sum", "d", True)}, following="end_ms")
    return counted.where("end_ms IS NOT NULL").select("rec", "start_ms", "end_ms", "n")


def overlapping_ranges(turns: DataFrame, shard: int = HOUR) -> DataFrame:
    """Ranges in which two or more speakers talk; ranges that touch are one."""
    x = islands(concurrency(turns, shard).where("n >= 2"), ["rec"], "start_ms", "end_ms", ["end_ms"], shard_of("start_ms", shard))
    return x.groupBy("rec", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def max_overlapping_speakers(turns: DataFrame) -> DataFrame:
    return concurrency(turns).groupBy("rec").agg(F.max("n").alias("n"))


def _as_right(turns: DataFrame, *more: str) -> DataFrame:
    return turns.select("rec", *more, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))


def range_speakers(ranges: DataFrame, turns: DataFrame) -> DataFrame:
    met = interval_join(ranges.select("rec", "start_ms", "end_ms"), _as_right(turns, "speaker"), ["rec"])
    return met.groupBy("rec", "start_ms", "end_ms", "speaker").agg(F.lit(1).alias("one")).groupBy("rec", "start_ms", "end_ms").agg(F.count("speaker").alias("n"))


def routed(counts: DataFrame) -> DataFrame:
    """The model for each range; ranges of other than two or three speakers have none."""
    return counts.withColumn("model", route_model(F.col("n")))


def gaps(vad: DataFrame, recordings: DataFrame, shard: int = HOUR) -> DataFrame:
    """What speech (rec, start_ms, end_ms) leaves of [0, total_ms) in each recording."""
    x = running(vad.select("rec", "start_ms", "end_ms"), ["rec"], ["start_ms", "end_ms"], shard_of("start_ms", shard), {"cursor": ("max", "end_ms", False)})
    inner = x.join(recordings, "rec").select("rec", F.coalesce("cursor", F.lit(0)).alias("start_ms"), F.least("start_ms", "total_ms").alias("end_ms"))
    ends = vad.groupBy("rec").agg(F.max("end_ms").alias("last"))
    tail = recordings.join(ends, "rec", "left").select("rec", F.coalesce("last", F.lit(0)).alias("start_ms"), F.col("total_ms").alias("end_ms"))
    return inner.unionByName(tail).where("end_ms > start_ms")


def speech_share(vad: DataFrame, recordings: DataFrame) -> DataFrame:
    said = vad.groupBy("rec").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    x = recordings.join(said, "rec", "left").select("rec", "total_ms", F.coalesce("speech_ms", F.lit(0)).alias("speech_ms"))
    return x.withColumn("pct", F.when(F.col("total_ms") > 0, 100 * F.col("speech_ms") / F.col("total_ms")).otherwise(0.0))


def attribute_words(words: DataFrame, turns: DataFrame, cell: int | None = None) -> DataFrame:
    """Each word's speaker: the one whose turns share most time with it (ties: smallest id), all active speakers, and a confidence.

    Time shared with several turns of one speaker adds up. With one active speaker the confidence is that speaker's best
    turn's; with several it is weighted by the share of the time; words nobody speaks stay, with confidence 0.
    """
    met = interval_totals(words.select("rec", "word_id", "start_ms", "end_ms"), _as_right(turns, "speaker", "conf"), ["rec"], "speaker", "conf", cell)
    # Dealt by word once: what follows, the join with words too, needs no other shuffle.
    each = met.repartition("rec", "word_id").groupBy("rec", "word_id", "speaker").agg(F.sum("ms").alias("ms"), F.max("best").cast(turns.schema["conf"].dataType).alias("conf")).where("ms > 0")
    best = each.groupBy("rec", "word_id").agg(F.min(F.struct((-F.col("ms")).alias("less"), "speaker", "conf")).alias("best"), F.sum("ms").alias("all_ms"), F.array_sort(F.collect_list("speaker")).alias("active"))
    share = F.when(F.size("active") == 1, 1.0).otherwise(-F.col("best.less") / F.greatest(F.col("all_ms"), F.lit(1)))
    x = words.join(best, ["rec", "word_id"], "left")
    return x.select("rec", "word_id", "text", "start_ms", "end_ms", F.col("best.speaker").alias("speaker"), F.coalesce("active", F.array().cast("array<string>")).alias("active"), F.coalesce(share * F.col("best.conf"), F.lit(0.0)).alias("confidence"))


def uncertain(attributed: DataFrame) -> DataFrame:
    return attributed.where(F.size("active") > 1)


def talk_time(attributed: DataFrame) -> DataFrame:
    """Words and their time by recording and speaker."""
    return attributed.groupBy("rec", "speaker").agg(F.count("*").alias("n_words"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.avg("confidence").alias("confidence"))


def dominant_speaker(track_turns: DataFrame) -> DataFrame:
    """track, speaker, conf: who talks longest in a track (ties: smallest id), and the share."""
    each = track_turns.groupBy("track", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    x = each.groupBy("track").agg(F.min(F.struct((-F.col("ms")).alias("less"), "speaker")).alias("best"), F.sum("ms").alias("all_ms"))
    return x.select("track", F.col("best.speaker").alias("speaker"), F.when(F.col("all_ms") > 0, -F.col("best.less") / F.col("all_ms")).otherwise(0.0).alias("conf"))


def identify_slot(frame_probs: DataFrame, digits: int = 9) -> DataFrame:
    """track, slot, conf, probs from frames (track, probs array): mean per slot, the first largest.

    Means are rounded to `digits` before they are compared, so a tie does not hang on the order in which frames are added.
    """
    means = frame_probs.select("track", F.posexplode("probs").alias("slot", "p")).groupBy("track", "slot").agg(F.round(F.avg("p"), digits).alias("p"))
    x = means.groupBy("track").agg(F.max(F.struct("p", (-F.col("slot")).alias("minus"))).alias("best"), F.array_sort(F.collect_list(F.struct("slot", "p"))).alias("all"))
    return x.select("track", (-F.col("best.minus")).alias("slot"), F.col("best.p").alias("conf"), F.transform("all", lambda s: s["p"]).alias("probs"))


def order_tracks(tracks: DataFrame) -> DataFrame:
    """Each track's place in its recording, by slot, those without one (999) last: the tracks of its slot before it, and of all smaller slots."""
    x = tracks.withColumn("__slot", F.coalesce("slot", F.lit(999)))
    # A slot is a shard, so only tracks of one slot are sorted together.
    nth = running(x, ["rec"], ["track"], F.col("__slot"), {"place": ("sum", F.lit(1).cast("long"), True)})
    return nth.withColumn("place", F.col("place").cast("int")).drop("__slot")


def map_slots(tracks: DataFrame, turns: DataFrame) -> DataFrame:
    """The speaker of each track's slot, null unless that speaker is active within the track's range."""
    active = interval_totals(tracks.select("rec", "track", "start_ms", "end_ms"), _as_right(turns, "speaker"), ["rec"], "speaker").select("rec", "track", "speaker").distinct().withColumn("slot", slot_of(F.col("speaker")))
    return tracks.join(active, ["rec", "track", "slot"], "left").select(*tracks.columns, "speaker")


def diarizer_summary(turns: DataFrame) -> DataFrame:
    x = turns.groupBy("rec").agg(F.count_distinct("speaker").alias("speakers"), F.count("*").alias("segments"))
    return x.join(max_overlapping_speakers(turns), "rec", "left").withColumnRenamed("n", "max_overlap")


def compare_diarizers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Speakers, segments and largest overlap of two systems side by side; nulls where one has no turns."""
    left, right = (diarizer_summary(t).select("rec", *(F.col(c).alias(f"{c}_{k}") for c in ("speakers", "segments", "max_overlap"))) for t, k in ((a, "a"), (b, "b")))
    return left.join(right, "rec", "full_outer")


def timeline_from_slots(final: DataFrame, tentative: DataFrame) -> DataFrame:
    """Turns of slots' final and tentative segments."""
    both = final.withColumn("is_final", F.lit(True)).unionByName(tentative.withColumn("is_final", F.lit(False)))
    return both.select("rec", F.concat(F.lit("speaker_"), F.col("slot").cast("string")).alias("speaker"), "start_ms", "end_ms", "is_final")


def merge_branches(base: DataFrame, *branches: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Field by field, the last branch that has a value wins; base fills what none has."""
    fields = [c for c in base.columns if c not in keys]
    x = base.select(*keys, *(F.col(c).alias(f"0_{c}") for c in fields))
    for k, b in enumerate(branches, 1):
        x = x.join(b.select(*keys, *(F.col(c).alias(f"{k}_{c}") for c in fields if c in b.columns)), list(keys), "full_outer")
    found = set(x.columns)
    return x.select(*keys, *(F.coalesce(*(F.col(f"`{k}_{c}`") for k in range(len(branches), -1, -1) if f"{k}_{c}" in found)).alias(c) for c in fields))


def validate_format(signals: DataFrame, rate: int, channels: int) -> tuple[DataFrame, DataFrame]:
    """Recordings (rec, sample_rate, channels, n_samples) that fit, and the others with the first reason."""
    reason: Column = (
        F.when((F.col("sample_rate") <= 0) | (F.col("channels") <= 0), "not a signal").when(F.col("n_samples") % F.greatest(F.col("channels"), F.lit(1)) != 0, "samples are not whole frames")
        .when(F.col("sample_rate") != rate, "sample rate").when(F.col("channels") != channels, "channels")
    )
    x = signals.withColumn("reason", reason)
    return x.where("reason IS NULL").drop("reason"), x.where("reason IS NOT NULL")
