"""The model surface: a user's function over chunks, segments or texts; Spark deals, batches and stitches.

A function gets a list of numpy arrays and returns one result each. It is shipped once to a task and called batch by batch;
`make` may instead build it in the worker, once a process and factory, where a model has to be loaded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUILT: dict[str, Callable] = {}


def _built(make: Callable[[], Callable], name: str) -> Callable:
    if name not in _BUILT:
        _BUILT[name] = make()
    return _BUILT[name]


def apply_model(chunks: DataFrame, fn: Callable | None = None, make: Callable[[], Callable] | None = None, batch: int = 16, barrier: bool = False, profile: ResourceProfile | None = None, tasks: int | None = None) -> DataFrame:
    """chunks with samples put through fn.

    profile: what each of its tasks needs (GPUs, memory), where the cluster manager grants it. barrier: all tasks of the stage
    start together or not at all, for models whose workers talk to each other; chunks are dealt to as many as there are slots,
    or `tasks`, as the slots of a profile aren't known before.
    """
    name = uuid.uuid4().hex  # of this factory, in every worker

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = fn or _built(make, name)
        for pdf in it:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield part.assign(samples=[np.asarray(x, float) for x in f([np.asarray(s) for s in part["samples"]])])

    if barrier:  # by a shuffle of its own: a barrier's stage must have one number of partitions from its start to its end
        chunks = chunks.repartition(tasks or _slots(chunks.sparkSession))
    return chunks.mapInPandas(run, chunks.schema, barrier, profile)


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def register_separator(chunks: DataFrame, name: str, fn: Callable, k: int, batch: int = 16) -> None:
    """A table function for SQL: name(TABLE(...) PARTITION BY ... ORDER BY ...) gives k rows for each row like those of chunks.

    fn sees the rows of a partition in its order, `batch` at a time, and may keep what it learns of them: each partition has a
    function of its own where fn is a class, which is made anew for it.
    """
    columns, at = chunks.columns, chunks.columns.index("samples")

    class Separator:
        def __init__(self):
            self.fn, self.rows = fn() if isinstance(fn, type) else fn, []

        def eval(self, row: Row):
            self.rows.append(tuple(row))
            if len(self.rows) == batch:
                yield from self.flush()

        def terminate(self):
            yield from self.flush()

        def flush(self):
            rows, self.rows = self.rows, []
            made = self.fn([np.asarray(r[at], float) for r in rows]) if rows else []
            if any(len(m) != k for m in made):
                raise ValueError(f"a separator of {k} outputs returned another number")
            for r, m in zip(rows, made, strict=True):
                for j in range(k):
                    yield (*r[:at], np.asarray(m[j], float).tolist(), *r[at + 1 :], j)

    schema = T.StructType([*(T.StructField(c, T.ArrayType(T.DoubleType())) if c == "samples" else chunks.schema[c] for c in columns), T.StructField("output_idx", T.IntegerType())])
    chunks.sparkSession.udtf.register(name, F.udtf(Separator, returnType=schema))


def separate(chunks: DataFrame, fn: Callable, k: int, batch: int = 16) -> DataFrame:
    """k rows for each chunk, with output_idx; fn returns k arrays for each."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                made = fn([np.asarray(s) for s in part["samples"]])
                if any(len(m) != k for m in made):
                    raise ValueError(f"a separator of {k} outputs returned another number")
                for j in range(k):
                    yield part.assign(samples=[np.asarray(m[j], float) for m in made], output_idx=np.int32(j))

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("output_idx", T.IntegerType())]))


def analyze(signals: DataFrame, fn: Callable, schema: str, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Rows that fn finds in each signal (a list of dicts for each array), under the signal's keys."""
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = fn([np.asarray(s) for s in pdf["samples"]])
            rows = [(*(pdf[k].iloc[i] for k in keys), *(r.get(f) for f in fields)) for i, rs in enumerate(found) for r in rs]
            yield pd.DataFrame(rows, columns=[*keys, *fields])

    own = ", ".join(f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys)
    return signals.mapInPandas(run, f"{own}, {schema}")


def embed(segments: DataFrame, fn: Callable) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(e, float) for e in fn([np.asarray(s) for s in samples])])

    return segments.withColumn("embedding", run("samples"))


def voice_table(calibrations: DataFrame, rate: int, fn: Callable, to: int = 16000, mode: str = "auto", most: int = 60 * 48_000) -> DataFrame:
    """voice_id, embedding of recordings of one calibration text, one for each voice (rec), at the rate that fn takes. A calibration is short: a recording of over `most` frames is an error."""
    from .signals import lengths, reblock, resample

    x = resample(calibrations, rate, to, mode)
    if lengths(x).where(F.col("n") > most).limit(1).count():
        raise ValueError(f"a calibration of over {most} frames")
    return embed(reblock(x, most), fn).select(F.col("rec").cast("string").alias("voice_id"), "embedding")


def map_text(texts: DataFrame, fn: Callable) -> DataFrame:
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(fn(text.tolist()))

    return texts.withColumn("text", run("text"))


def fan_out(signals: DataFrame, targets: DataFrame, fn: Callable, most: int = 1000) -> DataFrame:
    """A row for each signal and target (target, weights): targets are few and go to every task, so a chunk crosses once."""
    known = targets.limit(most + 1).toPandas()
    if len(known) > most:
        raise ValueError(f"over {most} targets")
    shared = signals.sparkSession.sparkContext.broadcast([(r.target, np.asarray(r.weights, float)) for r in known.itertuples()])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, w in shared.value:
                yield pdf.assign(samples=[np.asarray(fn(np.asarray(s), w), float) for s in pdf["samples"]], target=name)

    return signals.mapInPandas(run, T.StructType([*signals.schema.fields, T.StructField("target", T.StringType())]))


def adapt(signals: DataFrame, requirements: DataFrame, mode: str = "auto") -> DataFrame:
    """signals (rec, channel, sample_rate, blocks) at the rate and number of channels that requirements (rec, rate, channels) ask for.

    Rates and channels are values of a recording's rows: all are converted in one pass, whatever pairs of rates there are, and
    what already fits is left as it is. Recordings without a requirement are left out.
    """
    from ..functions.lineage import settle
    from .signals import BLOCK, converted, resample_own

    own = signals.groupBy("rec").agg(F.max("sample_rate").alias("sample_rate"), F.count_distinct("channel").alias("have"))
    needs = settle(requirements.select("rec", F.col("rate").cast("int").alias("to"), F.col("channels").alias("want")).join(own, "rec").select("rec", F.col("sample_rate").cast("int").alias("rate"), "to", "have", "want"))
    x = converted(signals.select("rec", "channel", *BLOCK).join(needs, "rec"), ("rate", "to"))
    return resample_own(x, needs, mode).select("rec", "channel", *BLOCK, F.col("to").alias("sample_rate"))
