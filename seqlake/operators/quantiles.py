"""Exact quantiles without gathering a column in one task.

A wanted rank is narrowed by passes over the data. Each pass asks a bounded sketch for two
values around the rank among the rows still in its bracket, and in the next
aggregate counts the rows below, at and above them exactly, so a wrong sketch costs a pass, never the
result. A bracket of at most ``KEEP`` rows is fetched and read off. All columns and
ranks share the passes. Memory: sketches of ``ACCURACY`` and ``KEEP`` values per open
rank, at any row count and any distribution (a value held by a third of all rows ends its rank's search).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
KEEP = 5_000


@dataclass
class _Bracket:
    """Rows of one column strictly between ``low`` and ``high`` (None: open) hold the row of rank ``rank`` (from 0)."""

    column: int
    rank: int
    size: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None
    reach: float = 3.0 / ACCURACY

    def inside(self, x: Column) -> Column:
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > F.lit(self.low))
        if self.high is not None:
            cond = cond & (x < F.lit(self.high))
        return F.when(cond, x)

    def around(self) -> tuple[float, float]:
        at = (self.rank - self.below) / max(self.size - 1, 1)
        return max(0.0, at - self.reach), min(1.0, at + self.reach)


def _narrow(b: _Bracket, a: float, c: float, under: int, upto: int, over_under: int, over_upto: int) -> None:
    """``under``/``upto``: rows < a and <= a; ``over_under``/``over_upto``: the same for c >= a."""
    if under <= b.rank < upto:
        b.value = a
    elif over_under <= b.rank < over_upto:
        b.value = c
    elif upto <= b.rank < over_under:
        b.low, b.high, b.below, b.size = a, c, upto, over_under - upto
    elif b.rank < under:  # the sketch missed: the rank lies on one side, which is smaller as well
        b.high, b.size, b.reach = a, under - b.below, b.reach * 4
    else:
        b.size -= over_upto - b.below
        b.low, b.below, b.reach = c, over_upto, b.reach * 4


def rank_values(df: DataFrame, columns: Sequence[str | Column], ranks: Sequence[Sequence[int]], sizes: Sequence[int]) -> list[dict[int, float]]:
    """Per column ``{rank: value}`` for 0-based ranks in rising order of the ``sizes`` non-null values."""
    x = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    wanted = [_Bracket(i, r, sizes[i]) for i in range(len(columns)) for r in sorted(set(ranks[i]))]
    while True:
        todo = [b for b in wanted if b.value is None and b.size > KEEP]
        if not todo:
            break
        cells = x.agg(*[F.percentile_approx(b.inside(F.col(f"c{b.column}")), list(b.around()), ACCURACY).alias(f"q{j}")
                        for j, b in enumerate(todo)]).first()
        ends = [tuple(float(v) for v in cells[f"q{j}"]) for j in range(len(todo))]
        counts = x.agg(*[agg for j, (b, (a, c)) in enumerate(zip(todo, ends)) for agg in (
            F.count_if(F.col(f"c{b.column}") < F.lit(a)).alias(f"u{j}"), F.count_if(F.col(f"c{b.column}") <= F.lit(a)).alias(f"v{j}"),
            F.count_if(F.col(f"c{b.column}") < F.lit(c)).alias(f"w{j}"), F.count_if(F.col(f"c{b.column}") <= F.lit(c)).alias(f"x{j}"))]).first()
        for j, (b, (a, c)) in enumerate(zip(todo, ends)):
            _narrow(b, a, c, *(counts[f"{k}{j}"] for k in "uvwx"))
    last = [b for b in wanted if b.value is None]
    ranges = sorted({(b.column, b.low, b.high) for b in last}, key=repr)
    if ranges:  # each at most KEEP values
        held = {r: next(b for b in last if (b.column, b.low, b.high) == r) for r in ranges}
        got = x.agg(*[F.sort_array(F.collect_list(held[r].inside(F.col(f"c{r[0]}")))).alias(f"l{j}") for j, r in enumerate(ranges)]).first()
        for b in last:
            b.value = float(got[f"l{ranges.index((b.column, b.low, b.high))}"][b.rank - b.below])
    return [{b.rank: b.value for b in wanted if b.column == i} for i in range(len(columns))]


def quantiles(df: DataFrame, columns: Sequence[str | Column], probs: Sequence[float]) -> list[list[float] | None]:
    """Linearly interpolated quantiles of each column's non-null values; None for a column without any."""
    n = df.agg(*[F.count((F.col(c) if isinstance(c, str) else c).cast("double")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = [int(n[f"n{i}"]) for i in range(len(columns))]
    at = [[p * (s - 1) for p in probs] for s in sizes]
    ranks = [[r for h in hs for r in (math.floor(h), math.ceil(h))] if s else [] for hs, s in zip(at, sizes)]
    values = rank_values(df, columns, ranks, sizes)
    out: list[list[float] | None] = []
    for hs, s, v in zip(at, sizes, values):
        out.append([v[math.floor(h)] + (v[math.ceil(h)] - v[math.floor(h)]) * (h - math.floor(h)) for h in hs] if s else None)
    return out
