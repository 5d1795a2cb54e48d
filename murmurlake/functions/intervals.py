"""Predicates on half-open intervals, and the interval join by sweeps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Touching does not overlap."""
    return (s1 < e2) & (e1 > s2)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Struct of start and end; null if empty or of no length."""
    start, end = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(end > start, F.struct(start.alias("start"), end.alias("end")))


def shared(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the intersection, 0 if there is none."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def slot_of(speaker: Column) -> Column:
    """n of speaker_<n>; null if that is no number."""
    return F.element_at(F.split(speaker, "_"), -1).try_cast("int")


def route_model(n: Column) -> Column:
    return F.when(n == 2, "separate_2_noisy").when(n == 3, "separate_3").otherwise(F.lit(None))


#: Rows of both sides that one sweep takes.
SWEEP_ROWS = 100_000


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], cell: int | None = None, rows: int = SWEEP_ROWS) -> DataFrame:
    """Pairs that overlap: left (start_ms, end_ms) with right (r_start, r_end) of the same keys.

    Time is cut into cells as long as the mean interval (measured, if `cell` isn't given), so that an interval lies in two
    cells on average, whatever the mix of long and short ones, and a long recording is many cells. Cells are dealt to sweeps
    by hash; a row goes there once for each of its cells. Of two intervals that overlap, the one that starts later does so
    within the other: right ones that start in a left one are a run of the cell's starts, and so are left ones that start in
    a right one. Two searches in sorted starts find these runs, so a sweep costs its rows and its pairs, not their product.
    The pair is told in the cell of that later start, and nowhere else.
    """
    cell, a, b = _dealt(left, right, keys, cell, rows)
    names = [left.columns, [c for c in right.columns if c not in keys]]
    schema = T.StructType([*left.schema.fields, *(right.schema[c] for c in names[1])])

    def sweep(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j = overlapping(*(_numbers(t, *k) for t, k in zip((a, b), _BOUNDS, strict=True)), cell)
        out = [a[c].take(i) for c in names[0]] + [b[c].take(j) for c in names[1]]
        same = np.ones(len(i), bool)
        for k in keys:  # a hash is no proof
            same &= pa.compute.equal(a[k].take(i), b[k].take(j)).to_numpy()
        return pa.table(out, names=schema.names).filter(pa.array(same))

    return a.cogroup(b).applyInArrow(sweep, schema)


def interval_totals(left: DataFrame, right: DataFrame, keys: list[str], by: str, best: str | None = None, cell: int | None = None, rows: int = SWEEP_ROWS) -> DataFrame:
    """For each row of left and each value of `by` whose right rows overlap it: how long they share, and their largest `best`.

    left's columns, `by`, ms, and best as a double; to be added up by the caller, as a left row in several cells has a row for each.
    No pairs are made: cells are dealt as in interval_join, and in each the time shared is a difference of running sums over
    the right ones' sorted ends, and the largest value that of those active at the left one's start or starting later in
    it. A sweep costs its rows, and its left rows times the values of `by` in their cells. Rows that end before they start
    meet nothing.
    """
    cell, a, b = _dealt(left.where("end_ms >= start_ms"), right.where("r_end >= r_start").select(*keys, by, *([best] if best else []), "r_start", "r_end"), keys, cell, rows)
    names = left.columns
    schema = T.StructType([*left.schema.fields, right.schema[by], T.StructField("ms", T.LongType()), T.StructField("best", T.DoubleType())])

    def sweep(a: pa.Table, b: pa.Table) -> pa.Table:
        line, of = _codes(a, b, [*keys, "__cell"]), pa.compute.dictionary_encode(b[by].combine_chunks(), null_encoding="encode")
        value = b[best].cast(pa.float64()).fill_null(-np.inf).to_numpy() if best else np.full(len(b), -np.inf)
        ends = [(t[s].to_numpy() - t["__cell"].to_numpy() * cell, t[e].to_numpy() - t["__cell"].to_numpy() * cell) for t, (s, e) in zip((a, b), _BOUNDS, strict=True)]
        i, k, ms, top = totals(line[0], *ends[0], line[1], of.indices.to_numpy(), *ends[1], value, cell)
        columns = [*(a[c].take(pa.array(i)) for c in names), of.dictionary.take(pa.array(k)), pa.array(ms), pa.array(top, mask=top == -np.inf)]
        return pa.table(columns, names=schema.names)

    return a.cogroup(b).applyInArrow(sweep, schema)


_BOUNDS = [("start_ms", "end_ms"), ("r_start", "r_end")]


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], cell: int | None, rows: int):
    """The cells' length, and both sides, a row for each cell, grouped by sweeps."""
    sides = [x.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, *ends])) for x, ends in zip((left, right), _BOUNDS, strict=True)]
    lengths = [x.select((F.col(e) - F.col(s)).cast("double").alias("n")) for x, (s, e) in zip(sides, _BOUNDS, strict=True)]
    n, mean = lengths[0].unionByName(lengths[1]).agg(F.count("*"), F.avg("n")).first()
    cell = cell or max(1, math.ceil(mean or 1))
    sweeps = max(1, math.ceil(2 * n / rows))

    def placed(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / cell), F.floor((F.greatest(F.col(s), F.col(e) - 1)) / cell)
        x = df.withColumn("__cell", F.explode(F.sequence(first, last))).withColumn("__h", F.xxhash64(*keys, "__cell"))
        return x.withColumn("__sweep", F.pmod("__h", F.lit(sweeps)))

    return cell, *(placed(x, *k).groupBy("__sweep") for x, k in zip(sides, _BOUNDS, strict=True))


def _codes(a: pa.Table, b: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row of both that is the same where the columns are."""
    code = np.zeros(len(a) + len(b), np.int64)
    for c in columns:
        own = pa.chunked_array([*a[c].chunks, *b[c].chunks], a[c].type).combine_chunks().dictionary_encode()
        _, code = np.unique(code * max(1, len(own.dictionary)) + own.indices.to_numpy(), return_inverse=True)
    return code[: len(a)], code[len(a) :]


def _numbers(t: pa.Table, s: str, e: str) -> tuple[np.ndarray, ...]:
    return tuple(t[c].to_numpy().astype(np.int64) for c in ("__h", "__cell", s, e))


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row each number of the runs [lo, hi) belongs to, and the number."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]


def overlapping(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], cell: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b (hash of key and cell, cell, start, end) that overlap, each pair once."""
    _, rank = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    ranks = rank[: len(a[0])], rank[len(a[0]) :]
    # Cells in a row: a time within its cell is a place on one line.
    zero = [(r * (cell + 1), x[1] * cell) for r, x in zip(ranks, (a, b), strict=True)]
    home = [np.flatnonzero(x[2] // cell == x[1]) for x in (a, b)]
    order, place = [], []
    for (base, begin), x, h in zip(zero, (a, b), home, strict=True):
        at = (base + x[2] - begin)[h]
        o = np.argsort(at, kind="stable")
        order.append(h[o])
        place.append(at[o])
    clip = lambda t, k: np.clip(t - zero[k][1], 0, cell) + zero[k][0]
    of_a, at = _runs(np.searchsorted(place[1], clip(a[2], 0)), np.searchsorted(place[1], clip(a[3], 0)))
    i, j = of_a, order[1][at]
    of_b, at = _runs(np.searchsorted(place[0], clip(b[2] + 1, 1)), np.searchsorted(place[0], clip(b[3], 1)))
    i, j = np.concatenate([i, order[0][at]]), np.concatenate([j, of_b])
    real = (a[2][i] < b[3][j]) & (a[3][i] > b[2][j])
    return i[real], j[real]


#: Left rows times values that are worked on at a time.
_AT_ONCE = 1_000_000


def totals(line: np.ndarray, start: np.ndarray, end: np.ndarray, r_line: np.ndarray, of: np.ndarray, r_start: np.ndarray, r_end: np.ndarray, value: np.ndarray, cell: int) -> tuple[np.ndarray, ...]:
    """Left row, value of `of`, time shared and largest value, by left row and value that overlap on one line.

    Times count from the cell's begin, and may lie outside [0, cell). Places are in half steps, so that an interval without
    length, which must lie within another one, differs from one that starts there.
    """
    n_of = int(of.max()) + 1 if len(of) else 1
    group, at = np.unique(r_line * n_of + of, return_inverse=True)
    step = 2 * cell + 8
    place = lambda g, t: g * step + 2 * np.clip(t, -1, cell + 1) + 2
    long = r_end > r_start
    s, e, w = r_start[long], r_end[long], value[long]
    g = at[long]
    from_, to = place(g, s) + 1, place(g, e)  # a left one is met while its place lies in [from_, to)
    froms, tos = np.sort(from_), np.sort(to)
    # How long all have been active up to a time: running sums of what starts less what ends.
    clipped = [(np.sort(g * step + np.clip(t, 0, cell)), np.clip(t, 0, cell)[np.lexsort((np.clip(t, 0, cell), g))]) for t in (s, e)]
    before = [np.concatenate([[0], np.cumsum(t)]) for _, t in clipped]
    offset = np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(group)))])
    # All starts, those without length too.
    begin = place(at, r_start)
    order = np.argsort(begin, kind="stable")
    begin, begun = begin[order], value[order]
    out = []
    first, last = np.searchsorted(group, line * n_of), np.searchsorted(group, (line + 1) * n_of)
    cuts = np.searchsorted(np.cumsum(last - first), np.arange(0, max(1, int((last - first).sum())), _AT_ONCE))
    for lo, hi in zip(cuts, [*cuts[1:], len(line)], strict=True):
        i, q = _runs(first[lo:hi], last[lo:hi])
        i += lo
        a, b = start[i], end[i]
        here, stop = np.clip(a, 0, cell), np.clip(b, 0, cell)
        at_a = place(q, here) + (b > a)
        active = np.searchsorted(froms, at_a, "right") - np.searchsorted(tos, at_a, "right")
        c, d = np.searchsorted(begin, place(q, np.where(a < 0, 0, a + 1))), np.searchsorted(begin, place(q, stop))
        ms = np.zeros(len(i), np.int64)
        for t, sign in ((stop, 1), (here, -1)):
            for (points, _), sums, way in zip(clipped, before, (1, -1), strict=True):
                n = np.searchsorted(points, q * step + t)
                ms += sign * way * ((n - offset[q]) * t - (sums[n] - sums[offset[q]]))
        met = np.flatnonzero((active > 0) | (d > c))
        top = np.maximum(_covering(from_, to, w, at_a[met]), _largest(begun, c[met], d[met]))
        out.append((i[met], group[q[met]] % n_of, np.where(b > a, ms, 0)[met], top))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _levels(n: np.ndarray) -> np.ndarray:
    """The largest k with 2^k <= n."""
    return np.frexp(np.maximum(n, 1).astype(float))[1] - 1


def _largest(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest of x[lo:hi] of each run, -inf for none: of two runs of a power of two that cover it."""
    out, level, some = np.full(len(lo), -np.inf), _levels(hi - lo), hi > lo
    for k in range(int(level[some].max()) + 1 if some.any() else 0):
        if k:
            x = np.maximum(x[: -(1 << k - 1)], x[1 << k - 1 :])
        now = some & (level == k)
        out[now] = np.maximum(x[lo[now]], x[hi[now] - (1 << k)])
    return out


def _covering(from_: np.ndarray, to: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The largest value of the intervals [from_, to) that cover each place, -inf for none: each is two runs of a power of two of the sorted places, which pass their value down."""
    points, back = np.unique(at, return_inverse=True)
    lo, hi = np.searchsorted(points, from_), np.searchsorted(points, to)
    some, level, x = hi > lo, _levels(hi - lo), np.full(len(points), -np.inf)
    for k in range(int(level[some].max()) if some.any() else 0, -1, -1):
        now = some & (level == k)
        np.maximum.at(x, lo[now], value[now])
        np.maximum.at(x, hi[now] - (1 << k), value[now])
        if k:
            half = 1 << k - 1
            y = x.copy()
            np.maximum(y[half:], x[:-half], out=y[half:])
            x = y
    return x[back]
