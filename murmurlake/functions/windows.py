"""Running aggregates and islands over long groups: a recording of any length is never sorted in one task.

A group is cut into shards of its order column. Each shard is summed up, the sums are carried over the shards (one row a
shard), and rows are only sorted within their shard. Rows are read twice for that, so each function here writes its input to
the shared folder first, as a job of its own while the plan is made: steps that follow each other would else run all before
them again and again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

_AGG = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, lambda a, b: F.greatest(a, b))}


def _dealt(df: DataFrame, shard: Column, more: dict[str, Column]) -> DataFrame:
    """df with its shards, written: it is read once for the shards' sums and once for its rows."""
    return settle(df.withColumns({**more, "__shard": shard}))


def _carried(sums: DataFrame, keys: list[str], what: dict[str, Column]) -> DataFrame:
    """By shard, aggregates over all shards before it."""
    before = Window.partitionBy(*keys).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "__shard", *(c.over(before).alias(n) for n, c in what.items()))


def running(df: DataFrame, keys: list[str], order: list[str], shard: Column, what: dict[str, tuple[str, str | Column, bool]], following: str | None = None) -> DataFrame:
    """df with running aggregates. what: name -> (sum or max, column, whether the row itself counts).

    `following` names a column for the next row's first order value, null at a group's end. df is written first.
    """
    x = _dealt(df, shard, {f"__in_{n}": (F.col(c) if isinstance(c, str) else c) for n, (_, c, _) in what.items()})
    sums = x.groupBy(*keys, "__shard").agg(*(_AGG[f][0](f"__in_{n}").alias(f"__of_{n}") for n, (f, _, _) in what.items()), F.min(order[0]).alias("__first"))
    carry = _carried(sums, keys, {f"__from_{n}": _AGG[f][0](f"__of_{n}") for n, (f, _, _) in what.items()})
    if following:
        carry = carry.join(sums.select(*keys, "__shard", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__shard")).alias("__next")), [*keys, "__shard"])
    inner = Window.partitionBy(*keys, "__shard").orderBy(*order)
    x = x.join(carry, [*keys, "__shard"])
    made = {n: _AGG[f][1](F.col(f"__from_{n}"), _AGG[f][0](f"__in_{n}").over(inner.rowsBetween(Window.unboundedPreceding, 0 if own else -1))) for n, (f, _, own) in what.items()}
    if following:
        made[following] = F.coalesce(F.lead(order[0]).over(inner), "__next")
    return x.withColumns(made).drop("__shard", "__next", *(f"__{k}_{n}" for k in ("in", "from") for n in what))


def islands(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str], shard: Column, gap: int = 0, closed: bool = True) -> DataFrame:
    """df with the start of the island each interval is in: a new one starts when the gap to all before is over `gap` (closed) or reaches it. df is written first."""
    x = _dealt(df, shard, {})
    reach = _carried(x.groupBy(*keys, "__shard").agg(F.max(end).alias("__end")), keys, {"__before": F.max("__end")})
    inner = Window.partitionBy(*keys, "__shard").orderBy(start, *tie)
    apart = F.col(start) - F.greatest("__before", F.max(end).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce(apart > gap if closed else apart >= gap, F.lit(True))
    flagged = x.join(reach, [*keys, "__shard"]).withColumn("__new", F.when(new, F.col(start)))
    # Islands start in order, so the last start so far is the largest; an island may have begun in an earlier shard.
    opened = _carried(flagged.groupBy(*keys, "__shard").agg(F.max("__new").alias("__last")), keys, {"__open": F.max("__last")})
    island = F.coalesce(F.max("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "__open")
    return flagged.join(opened, [*keys, "__shard"]).withColumn("island", island).drop("__shard", "__before", "__new", "__open")


def shard_of(column: str, size: int) -> Column:
    return F.floor(F.col(column) / size)
