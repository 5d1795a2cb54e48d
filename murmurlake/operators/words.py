"""Tokens to words, token windows, and word labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import running, shard_of


def merge_tokens_into_words(tokens: DataFrame, shard: int = 10_000) -> DataFrame:
    """Words of tokens (rec, idx, token, start_ms, end_ms, confidence).

    A token that starts with a space, newline or tab opens a word and is trimmed; others are appended as they are. A word
    runs from its first token's start to its last one's end, with their mean confidence; words without text go. A token
    of white space alone opens a word that the next token's text falls to, with its own start.
    """
    opens = F.col("token").rlike(r"^[ \n\t]").cast("long")
    x = running(tokens, ["rec"], ["idx"], shard_of("idx", shard), {"word_no": ("sum", opens, True)})
    piece = F.when(opens == 1, F.regexp_replace("token", r"^[ \n\t\r]+|[ \n\t\r]+$", "")).otherwise(F.col("token"))
    x = x.groupBy("rec", "word_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", piece.alias("p")))), lambda s: s["p"]), "").alias("word"),
        F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), F.avg("confidence").alias("confidence"),
    )
    return x.where("word <> ''")


def with_fallback(words: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings without word timings (rec, text, n_samples) get one row over all of their 16 kHz audio."""
    rest = recordings.join(words.select("rec").distinct(), "rec", "left_anti")
    return words.unionByName(rest.select("rec", F.lit(0).cast("long").alias("word_no"), F.col("text").alias("word"), F.lit(0).cast("long").alias("start_ms"), F.floor(F.col("n_samples") / 16).cast("long").alias("end_ms"), F.lit(1.0).alias("confidence")))


def merge_token_windows(windows: DataFrame, overlap_sec: float, rate: float) -> DataFrame:
    """rec, ids of overlapping windows (rec, window_idx, ids): half the overlap's tokens go at every inner edge."""
    drop = int(overlap_sec / 2 * rate)
    w = Window.partitionBy("rec")
    x = windows.withColumn("first", F.min("window_idx").over(w)).withColumn("last", F.max("window_idx").over(w))
    head = F.when(F.col("window_idx") > F.col("first"), drop).otherwise(0)
    tail = F.when(F.col("window_idx") < F.col("last"), drop).otherwise(0)
    x = x.withColumn("ids", F.slice("ids", head + 1, F.greatest(F.lit(0), F.size("ids") - head - tail)))
    return x.groupBy("rec").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window_idx", "ids"))), lambda s: s["ids"])).alias("ids"))


def word_labels(pieces: DataFrame, labels: list[str], shard: int = 10_000) -> DataFrame:
    """rec, word_no, label: scores of a word's pieces (rec, idx, is_subword, scores) averaged; the first largest class."""
    x = running(pieces, ["rec"], ["idx"], shard_of("idx", shard), {"word_no": ("sum", (~F.col("is_subword")).cast("long"), True)})
    mean = x.select("rec", "word_no", F.posexplode("scores").alias("k", "p")).groupBy("rec", "word_no", "k").agg(F.avg("p").alias("p"))
    best = mean.groupBy("rec", "word_no").agg(F.min(F.struct((-F.col("p")).alias("less"), "k")).alias("b"))
    return best.select("rec", "word_no", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("b.k") + 1).alias("label"))


def word_times(tokens: DataFrame, durations: DataFrame) -> DataFrame:
    """utt, idx, start, end (seconds) of tokens (utt, idx, phones, is_space) by the durations of their phones (utt, durations).

    Times are in half frames of 1/80 s. Durations are a leading one, one for each phone and for the space after a token, and
    a closing one. A token ends twice its phones' durations and once its space's after the clock, which then moves on by
    twice both; it starts where the token before it ended. The clock starts at twice the leading duration less 3, 0 at
    least. A token without phones (null) is no row; if a space follows, the clock takes in that space and two durations are
    used up. The first token that durations don't suffice for ends the utterance; utterances of under three have no times.
    """
    by = Window.partitionBy("utt").orderBy("idx")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    n, space = F.length("phones"), F.col("is_space").cast("int")
    silent = F.col("phones").isNull()
    x = tokens.join(durations, "utt").where(F.size("durations") >= 3)
    x = x.withColumn("i", (1 + F.coalesce(F.sum(F.when(silent, 2 * space).otherwise(n + space)).over(before), F.lit(0))).cast("int"))
    size, j = F.size("durations"), F.col("i") + F.coalesce(n, F.lit(0))
    x = x.withColumn("over", (F.col("i") >= size - 1) | (~silent & (j >= size))).withColumn("over", F.max("over").over(by)).where("NOT over")
    said = F.aggregate(F.slice("durations", F.col("i") + 1, F.coalesce(n, F.lit(0))), F.lit(0.0), lambda a, d: a + d)
    rest = F.when(F.col("is_space"), F.coalesce(F.get("durations", F.when(silent, F.col("i") + 1).otherwise(j)), F.lit(0.0))).otherwise(0.0)
    x = x.withColumn("said", F.when(silent, 0.0).otherwise(said)).withColumn("rest", rest.cast("double"))
    first = 2 * F.greatest(F.lit(0.0), F.col("durations")[0] - 3)
    clock = first + F.coalesce(F.sum(2 * (F.col("said") + F.col("rest"))).over(before), F.lit(0.0))
    x = x.withColumn("clock", clock).withColumn("left", F.col("clock") + 2 * F.col("said") + F.col("rest"))
    # Tokens without phones and space leave everything as it is.
    x = x.where(~silent | F.col("is_space")).withColumn("start", F.coalesce(F.lag("left").over(by), F.col("clock")))
    return x.where(~silent).select("utt", "idx", (F.col("start") / 80).alias("start"), (F.col("left") / 80).alias("end"))
