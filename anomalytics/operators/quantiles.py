"""Exact quantiles (linear interpolation, as PERCENTILE_CONT) by rank selection, one method at every size.

Spark's exact ``percentile`` merges a value->count map of the whole column into one reducer, so its memory grows with
the number of distinct values. Here a wanted rank is found by rounds of two distributed aggregations:

* ``percentile_approx`` (a mergeable sketch of bounded size, rank error <= count / accuracy) proposes a value for the
  rank and a bracket around it;
* one counting pass tells how many values lie below and up to each proposal, which settles the rank exactly when it
  falls on a proposed value, and otherwise leaves an open bracket of about ``2 * MARGIN / accuracy`` of the values.

The next round works inside the brackets that are left. A bracket with fewer values than ``accuracy`` is held by the
sketch without error, so it is settled in its round; every round shrinks a bracket by a factor of about a thousand.
Ties are settled by counts, so a value repeated on a third of all rows costs nothing extra. Only proposals and counts
reach the driver.

Nulls are ignored. NaN counts as the largest value, as in Spark's and DuckDB's order. The result is
``v[k] + (pos - k) * (v[k+1] - v[k])`` with ``pos = p * (n - 1)``, written in Spark's interpolation form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 50_000
MARGIN = 3.0


@dataclass(frozen=True)
class _Bracket:
    """Values strictly between lo and hi (None: open end); ``below`` values are <= lo, ``count`` lie inside."""
    lo: float | None
    hi: float | None
    below: int
    count: int

    def inside(self, x):
        cond = F.lit(True)
        if self.lo is not None:
            cond = cond & (x > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (x < F.lit(self.hi))
        return cond


def _interpolate(pos: float, lower: float, upper: float) -> float:
    lo_i, hi_i = math.floor(pos), math.ceil(pos)
    if lo_i == hi_i or lower == upper:
        return lower
    return (hi_i - pos) * lower + (pos - lo_i) * upper


def _select_ranks(x: DataFrame, n: int, ranks: list[int], accuracy: int) -> dict[int, float]:
    col = F.col("x")
    open_: dict[_Bracket, list[int]] = {_Bracket(None, None, 0, n): sorted(set(ranks))}
    done: dict[int, float] = {}
    while open_:
        aggs = []
        for i, (b, wanted) in enumerate(open_.items()):
            at = [(r - b.below + 0.5) / b.count for r in wanted]
            probs = sorted({min(max(f + d, 0.0), 1.0) for f in at for d in (-MARGIN / accuracy, 0.0, MARGIN / accuracy)})
            aggs.append(F.percentile_approx(F.when(b.inside(col), col), probs, accuracy).alias(f"b{i}"))
        proposed = [sorted(set(values), key=lambda v: (v != v, v)) for values in x.agg(*aggs).first()]
        counts = [F.count(F.lit(1)).alias("n_all")]
        for i, values in enumerate(proposed):
            for j, v in enumerate(values):
                counts += [F.count_if(col < F.lit(v)).alias(f"lt{i}_{j}"), F.count_if(col <= F.lit(v)).alias(f"le{i}_{j}")]
        found = x.agg(*counts).first()
        if found["n_all"] != n:
            raise ValueError(f"n={n} but the column has {found['n_all']} non-null values")
        still: dict[_Bracket, list[int]] = {}
        for i, ((b, wanted), values) in enumerate(zip(list(open_.items()), proposed, strict=True)):
            for r in wanted:
                lo, hi, below, end = b.lo, b.hi, b.below, b.below + b.count
                for j, v in enumerate(values):
                    lt, le = found[f"lt{i}_{j}"], found[f"le{i}_{j}"]
                    if lt <= r < le:
                        done[r] = float(v)
                        break
                    if le <= r:
                        lo, below = v, le
                    else:
                        hi, end = v, lt
                        break
                if r not in done:
                    still.setdefault(_Bracket(lo, hi, below, end - below), []).append(r)
        open_ = still
    return done


def exact_percentiles(df: DataFrame, column: str, probs, *, n: int | None = None,
                      accuracy: int = ACCURACY) -> list[float | None]:
    """Exact PERCENTILE_CONT of ``column`` (cast to DOUBLE, nulls ignored) for each p.

    ``n``, when given, must be the number of non-null values (the first counting pass checks it).
    """
    probs = [float(p) for p in probs]
    x = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    if n is None:
        n = x.count()
    if n == 0:
        return [None] * len(probs)
    positions = [p * (n - 1) for p in probs]
    values = _select_ranks(x, n, [r for pos in positions for r in (math.floor(pos), math.ceil(pos))], accuracy)
    return [_interpolate(pos, values[math.floor(pos)], values[math.ceil(pos)]) for pos in positions]
