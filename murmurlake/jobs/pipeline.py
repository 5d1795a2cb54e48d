"""Pipelines: stages over a set of named DataFrames, checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


class ConfigurationError(ValueError):
    """A stage lacks what it needs."""


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    run: Callable[[Tables], Tables]


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...] = field(default_factory=tuple)

    def then(self, name: str, needs: tuple[str, ...], gives: tuple[str, ...], run: Callable[..., DataFrame | tuple[DataFrame, ...]]) -> Pipeline:
        """A stage that calls run with the DataFrames it needs; it returns those it gives."""

        def step(t: Tables) -> Tables:
            out = run(*(t[n] for n in needs))
            return t | dict(zip(gives, out if isinstance(out, tuple) else (out,), strict=True))

        return Pipeline((*self.stages, Stage(name, needs, gives, step)))

    def detect(self, fn) -> Pipeline:
        return self.then("detect", ("signals",), ("vad",), fn)

    def diarize(self, fn) -> Pipeline:
        return self.then("diarize", ("signals",), ("turns",), fn)

    def transcribe(self, fn) -> Pipeline:
        return self.then("transcribe", ("signals",), ("words",), fn)

    def enhance(self, fn) -> Pipeline:
        return self.then("enhance", ("signals",), ("signals",), fn)

    def analyze(self, fn) -> Pipeline:
        return self.then("analyze", ("signals",), ("analysis",), fn)

    def classify(self, fn) -> Pipeline:
        return self.then("classify", ("signals",), ("sounds",), fn)

    def separate(self, fn) -> Pipeline:
        return self.then("separate", ("signals", "turns"), ("tracks",), fn)

    def separate_overlap(self, fn) -> Pipeline:
        """fn over what lies in ranges with several speakers (signals, ranges with a model each); ranges no model fits are left out."""
        from ..operators import timeline as t

        def run(signals: DataFrame, turns: DataFrame) -> DataFrame:
            ranges = t.routed(t.range_speakers(t.overlapping_ranges(turns), turns)).where("model IS NOT NULL")
            return fn(signals, ranges)

        return self.then("separate_overlap", ("signals", "turns"), ("tracks",), run)

    def separate_per_target(self, fn) -> Pipeline:
        """fn(signals, targets): a track for each signal and target."""
        return self.then("separate_per_target", ("signals", "targets"), ("tracks",), fn)

    def upscale(self, fn) -> Pipeline:
        """fn over the tracks at hand."""
        return self.then("upscale", ("tracks",), ("tracks",), fn)

    def merge(self) -> Pipeline:
        from ..operators.timeline import attribute_words

        return self.then("merge", ("words", "turns"), ("attributed",), attribute_words)

    def for_each(self, transform: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """A transform of tracks; the track is part of the key, so there is no loop."""
        return self.then("for_each", ("tracks",), ("tracks",), transform)

    def conditionally(self, table: str, predicate: Column, then: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame] = lambda df: df) -> Pipeline:
        """Rows for which predicate holds go one way, others (and unknown ones) the other."""
        sure = F.coalesce(predicate, F.lit(False))
        return self.then("conditionally", (table,), (table,), lambda df: then(df.where(sure)).unionByName(otherwise(df.where(~sure))))

    def parallel(self, table: str, branches: list[Callable[[DataFrame], DataFrame]], keys: tuple[str, ...] = ("rec",)) -> Pipeline:
        """Branches over one table; field by field the last that has a value wins."""
        from ..operators.timeline import merge_branches

        return self.then("parallel", (table,), (table,), lambda df: merge_branches(df, *(b(df) for b in branches), keys=keys))

    def check(self, tables: tuple[str, ...]) -> None:
        have = set(tables)
        for s in self.stages:
            if missing := [n for n in s.needs if n not in have]:
                raise ConfigurationError(f"{s.name} needs {', '.join(missing)}")
            have |= set(s.gives)

    def run(self, **tables: DataFrame) -> Tables:
        self.check(tuple(tables))
        for s in self.stages:
            tables = s.run(tables)
        return tables


def stage_metrics(events: DataFrame) -> DataFrame:
    """run, stage, duration from events (run, branch, stage, kind, at): branches' stages are named parallel[i].stage; total is the run's span."""
    name = F.when(F.col("branch").isNotNull(), F.format_string("parallel[%d].%s", F.col("branch"), F.col("stage"))).otherwise(F.col("stage"))
    each = events.groupBy("run", name.alias("stage")).agg((F.max("at") - F.min("at")).alias("duration"))
    return each.unionByName(events.groupBy("run").agg((F.max("at") - F.min("at")).alias("duration")).select("run", F.lit("total").alias("stage"), "duration"))
