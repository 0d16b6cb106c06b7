"""Exact quantiles of whole columns at any size.

``percentile`` keeps every distinct value of a group in one buffer, which does not
scale. Here each requested rank is held in an interval of values. A sketch with a guaranteed
rank error gives the first interval, one pass counts exactly what lies below, at and inside its ends, and
as long as many rows lie inside, a second sketch of only these rows makes it narrower: a share of about
``6 / accuracy`` of them is left each time, whatever the values look like. Then the few rows inside are ordered.
Only bounds, counts and the values asked for reach the driver: a few numbers per column and probability.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cindermap.functions.values import col, nan_to_null
from cindermap.operators.aggregate import column_stats

ACCURACY = 1_000  # of a sketch; each round of sketches narrows an interval to about 6 / ACCURACY of its rows
ORDERED = 100_000  # rows of one interval that are ordered in one task
_AT_ONCE = 400  # aggregates of one pass


def _columns(columns: Sequence[str] | Mapping[str, Column]) -> dict[str, Column]:
    if isinstance(columns, Mapping):
        return dict(columns)
    return {c: F.col(f"`{c}`") for c in columns}


@dataclass
class _Interval:
    """Values between ``low`` and ``high`` (both outside; None is open) of column ``i`` that hold the ``ranks``.

    ``below`` rows lie under or at ``low``, ``inside`` between.
    """

    i: int
    ranks: tuple[int, ...]
    inside: int
    below: int = 0
    low: object = None
    high: object = None

    def holds(self, x: Column) -> Column:
        above = x.isNotNull() if self.low is None else x > F.lit(self.low)
        return above if self.high is None else above & (x < F.lit(self.high))


def _first_pass(values: DataFrame, names: Sequence[str], probs: Sequence[float], accuracy: int, more: Sequence[Column]) -> tuple[list[int], list[list | None], list[Row]]:
    """(rows per column, ends of the first intervals per column, rows of ``more``) from one aggregate per ``_AT_ONCE`` columns."""
    margin = 3.0 / accuracy
    ends = [min(max(p + s * margin, 0.0), 1.0) for s in (-1, 1) for p in probs]
    counts, sketches, extra = [], [], []
    for start in range(0, len(names), _AT_ONCE):
        part = range(start, min(start + _AT_ONCE, len(names)))
        aggregates = [a for i in part for a in (F.count(f"x{i}"), F.percentile_approx(f"x{i}", ends, accuracy))]
        row = list(values.agg(*aggregates, *(more if start == 0 else [])).first())
        counts += row[0 : 2 * len(part) : 2]
        sketches += row[1 : 2 * len(part) : 2]
        extra += row[2 * len(part) :]
    return counts, sketches, extra


def _counted(values: DataFrame, asked: Sequence[tuple[_Interval, object, object]]) -> tuple[list[_Interval], dict[tuple[int, int], object]]:
    """Intervals cut at two values each, counted exactly: (those with ranks left, what is at the cuts as (column, rank): value)."""
    found: dict[tuple[int, int], object] = {}
    left: list[_Interval] = []
    for start in range(0, len(asked), _AT_ONCE // 4):
        part = asked[start : start + _AT_ONCE // 4]
        sums = []
        for interval, low, high in part:
            x = F.col(f"x{interval.i}")
            sums += [F.count_if(x < F.lit(low)), F.count_if(x <= F.lit(low)), F.count_if(x < F.lit(high)), F.count_if(x <= F.lit(high))]
        numbers = list(values.agg(*sums).first())
        for k, (interval, low, high) in enumerate(part):
            under, upto, before, through = numbers[4 * k : 4 * k + 4]
            parts = {
                (interval.low, low, interval.below, under): [],
                (low, high, upto, before): [],
                (high, interval.high, through, interval.below + interval.inside): [],
            }
            for rank in interval.ranks:
                if under < rank <= upto:
                    found[interval.i, rank] = low
                elif before < rank <= through:
                    found[interval.i, rank] = high
                else:
                    next(ranks for (_, _, less, more), ranks in parts.items() if less < rank <= more).append(rank)
            left += [_Interval(interval.i, tuple(r), more - less, less, a, b) for (a, b, less, more), r in parts.items() if r]
    return left, found


def _narrowed(values: DataFrame, intervals: Sequence[_Interval], accuracy: int) -> list[tuple[_Interval, object, object]]:
    """Cuts around the ranks of each interval, from a sketch of the rows inside."""
    out = []
    for start in range(0, len(intervals), _AT_ONCE):
        part = intervals[start : start + _AT_ONCE]
        sketches = []
        for interval in part:
            x, margin = F.col(f"x{interval.i}"), 3.0 / accuracy
            low, high = ((rank - interval.below) / interval.inside for rank in (min(interval.ranks), max(interval.ranks)))
            sketches.append(F.percentile_approx(F.when(interval.holds(x), x), [max(low - margin, 0.0), min(high + margin, 1.0)], accuracy))
        out += [(interval, *ends) for interval, ends in zip(part, values.agg(*sketches).first())]
    return out


def _ordered(values: DataFrame, intervals: Sequence[_Interval]) -> dict[tuple[int, int], object]:
    """The values at the ranks of the intervals, (column, rank): value. Only cells inside an interval become rows."""
    if not intervals:
        return {}
    cells = F.array(*[F.when(interval.holds(F.col(f"x{interval.i}")), F.struct(F.lit(j).alias("j"), F.col(f"x{interval.i}").alias("x"))) for j, interval in enumerate(intervals)])
    inside = values.select(F.explode(F.array_compact(cells)).alias("c")).groupBy("c.j", "c.x").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("j").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("upto", F.sum("m").over(upto))
    wanted = F.array(*[F.array(*[F.lit(r - interval.below) for r in interval.ranks]) for interval in intervals])
    held = placed.filter(F.exists(F.get(wanted, F.col("j")), lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("m"))))
    found = {}
    for row in held.collect():  # at most as many as ranks
        interval = intervals[row["j"]]
        found |= {(interval.i, r): row["x"] for r in interval.ranks if row["upto"] - row["m"] < r - interval.below <= row["upto"]}
    return found


def _quantiles(
    df: DataFrame, exprs: Mapping[str, Column], probs: Sequence[float], accuracy: int, method: str, more: Sequence[Column] = ()
) -> tuple[dict[tuple[str, float], float | None], list[Row]]:
    if method not in ("linear", "inverse"):
        raise ValueError(method)
    names, probs = list(exprs), sorted({float(p) for p in probs})
    values = df.select("*", *[nan_to_null(e).alias(f"x{i}") for i, e in enumerate(exprs.values())])
    values = values if more else values.select(*[f"x{i}" for i in range(len(names))])
    sizes, sketches, extra = _first_pass(values, names, probs, accuracy, more)

    ranks: dict[tuple[int, float], tuple[int, int, float]] = {}
    for i, n in enumerate(sizes):
        for p in probs if n else ():
            if method == "inverse":
                low = high = max(math.ceil(Fraction(repr(p)) * n), 1)
                part = 0.0
            else:
                place = (n - 1) * p
                low, high, part = math.floor(place) + 1, math.ceil(place) + 1, place - math.floor(place)
            ranks[i, p] = (low, high, part)

    open_, asked = [], []
    for i, n in enumerate(sizes):
        whole = [_Interval(i, tuple(sorted({*ranks[i, p][:2]})), n) for p in probs] if n else []
        if n > ORDERED:
            asked += [(interval, sketches[i][j], sketches[i][len(probs) + j]) for j, interval in enumerate(whole)]
        elif n:
            open_.append(_Interval(i, tuple(sorted({r for w in whole for r in w.ranks})), n))
    values = values.select(*[f"x{i}" for i in range(len(names))])
    found: dict[tuple[int, int], object] = {}
    while asked:
        left, at_cuts = _counted(values, asked)
        found |= at_cuts
        open_ += [interval for interval in left if interval.inside <= ORDERED]
        wide = [interval for interval in left if interval.inside > ORDERED]
        asked = _narrowed(values, wide, accuracy) if wide else []
    found |= _ordered(values, open_)

    out = {}
    for i, name in enumerate(names):
        for p in probs:
            if (i, p) not in ranks:
                out[name, p] = None
                continue
            low, high, part = ranks[i, p]
            a, b = float(found[i, low]), float(found[i, high])
            out[name, p] = a + part * (b - a) if a != b else a
    return out, extra


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str] | Mapping[str, Column],
    probs: Sequence[float],
    accuracy: int = ACCURACY,
    method: str = "linear",
) -> DataFrame:
    """Long table ``(column, prob, value)``; missing values are ignored.

    ``method`` is ``linear`` (rank ``(n - 1) p + 1``, interpolated) or ``inverse``
    (the value of rank ``ceil(n p)``, at least 1, counted in whole numbers). A column without values has missing quantiles.

    Runs when it is called: a sketch, a count and one ordering of few rows, and a sketch and a count more for each factor of about
    ``accuracy / 6`` in the number of rows. ``df`` is read once per pass.
    """
    exprs = _columns(columns)
    found, _ = _quantiles(df, exprs, probs, accuracy, method)
    rows = [(c, float(p), found[c, float(p)]) for c in exprs for p in probs]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def quantile_array(
    df: DataFrame, column: str | Column, probs: Sequence[float], accuracy: int = ACCURACY, method: str = "linear"
) -> Column:
    """The quantiles of one column as an array of constants, in the order of ascending ``probs``."""
    found, _ = _quantiles(df, {"x": col(column)}, probs, accuracy, method)
    return F.array(*[F.lit(found["x", p]).cast("double") for p in sorted(map(float, probs))])


def quantile_row(
    df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """One row, one array of quantiles per column, by ascending ``probs``."""
    exprs = _columns(columns)
    found, _ = _quantiles(df, exprs, probs, accuracy, "linear")
    shape = ", ".join(f"`{c}` array<double>" for c in exprs)
    return df.sparkSession.createDataFrame([tuple([found[c, p] for p in sorted(map(float, probs))] for c in exprs)], shape)


def summary_table(df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY) -> DataFrame:
    """A10: N, mean, sd, min, quartiles and max of numeric columns, one row per column.

    The statistics come from the aggregate that makes the first sketch.
    """
    stats = column_stats({c: F.col(f"`{c}`") for c in columns})
    found, extra = _quantiles(df, _columns(columns), [0.25, 0.5, 0.75], accuracy, "linear", stats)
    number = lambda v: None if v is None else float(v)
    rows = [
        (c, s["n"], number(s["mean"]), number(s["sd"]), number(s["min"]), *[found[c, p] for p in (0.25, 0.5, 0.75)], number(s["max"]))
        for c, s in zip(columns, extra)
    ]
    return df.sparkSession.createDataFrame(rows, "statistic string, n long, mean double, sd double, min double, p25 double, median double, p75 double, max double")
