"""Exact values at given ranks without sorting the column and without one task holding it.

A bracket of two column values is kept around each wanted rank. A round asks for approximate
percentiles inside the brackets, then counts the rows below and at those probes, which either
hits the rank or shrinks the bracket by a factor near the sketch accuracy. When few enough rows
are left between the brackets they are counted per value and the rank is read off. Only counts
and probe values (a few per wanted rank) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
FINAL_ROWS = 1_000_000


@dataclass
class Wanted:
    """The ``rank``-th smallest (1-based) of the ``rows`` non-null values of ``column``.

    Values are compared as doubles; timestamps are asked for as microseconds.
    """

    name: str
    column: str
    rank: int
    rows: int               # rows inside the bracket, at first all non-null rows
    low: object = None      # open bracket; None means unbounded
    high: object = None
    below: int = 0          # rows <= low
    answer: object = None

    @property
    def value(self) -> Column:
        return F.col(self.column).cast("double")

    def in_bracket(self) -> Column:
        keep = self.value.isNotNull()
        if self.low is not None:
            keep = keep & (self.value > F.lit(self.low))
        if self.high is not None:
            keep = keep & (self.value < F.lit(self.high))
        return keep


def _same_bracket(open_: list[Wanted]) -> dict[tuple, list[Wanted]]:
    """Wanted ranks that look at the same values: they can share a sketch."""
    groups: dict[tuple, list[Wanted]] = {}
    for w in open_:
        groups.setdefault((w.column, w.low, w.high), []).append(w)
    return groups


def _probe(df: DataFrame, open_: list[Wanted]) -> list[tuple]:
    slack = 2.0 / ACCURACY
    groups = list(_same_bracket(open_).values())
    asked = []
    for i, group in enumerate(groups):
        at = []
        for w in group:
            q = (w.rank - w.below) / w.rows
            at += [max(0.0, q - slack), min(1.0, q + slack)]
        asked.append(F.percentile_approx(F.when(group[0].in_bracket(), group[0].value), at, ACCURACY).alias(f"p{i}"))
    found = {}
    for group, values in zip(groups, df.agg(*asked).first()):
        for j, w in enumerate(group):
            found[w.name] = (values[2 * j], values[2 * j + 1])
    return [found[w.name] for w in open_]


def _narrow(df: DataFrame, open_: list[Wanted], probes: list[tuple]) -> None:
    counts = []
    for i, (w, (a, b)) in enumerate(zip(open_, probes)):
        for tag, test in (("lt_a", w.value < F.lit(a)), ("le_a", w.value <= F.lit(a)),
                          ("lt_b", w.value < F.lit(b)), ("le_b", w.value <= F.lit(b))):
            counts.append(F.count_if(test).alias(f"{tag}{i}"))
    row = df.agg(*counts).first()
    for i, (w, (a, b)) in enumerate(zip(open_, probes)):
        lt_a, le_a, lt_b, le_b = (row[f"{t}{i}"] for t in ("lt_a", "le_a", "lt_b", "le_b"))
        if w.rank <= lt_a:
            w.high, w.rows = a, lt_a - w.below
        elif w.rank <= le_a:
            w.answer = a
        elif w.rank <= lt_b:
            w.low, w.high, w.below, w.rows = a, b, le_a, lt_b - le_a
        elif w.rank <= le_b:
            w.answer = b
        else:
            w.rows = w.below + w.rows - le_b
            w.low, w.below = b, le_b


def _read_off(df: DataFrame, open_: list[Wanted]) -> None:
    """Count the values left in each bracket and walk them in order.

    A bracket is a branch of its own that reads one column with the bracket as pushed filter.
    What is ordered in one task is at most ``final_rows`` values.
    """
    groups = list(_same_bracket(open_).values())
    parts = []
    for g, group in enumerate(groups):
        first = group[0]
        counts = (df.filter(first.in_bracket()).select(first.value.alias("v")).groupBy("v")
                  .agg(F.count(F.lit(1)).alias("n")))
        parts.append(counts.select(F.lit(g).alias("g"), "v", "n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("v"))
    offsets = F.array(*[F.array(*[F.lit(w.rank - w.below) for w in group]) for group in groups])
    mine = F.filter(F.get(offsets, F.col("g")), lambda o: (F.col("upto") >= o) & (F.col("upto") - F.col("n") < o))
    placed = reduce(DataFrame.unionByName, parts).withColumn("upto", upto).select("g", "v", mine.alias("hit"))
    for row in placed.filter(F.size("hit") > 0).collect():
        for w in groups[row["g"]]:
            if w.rank - w.below in row["hit"]:
                w.answer = row["v"]


def values_at_ranks(df: DataFrame, wanted: list[Wanted], final_rows: int = FINAL_ROWS) -> dict:
    """Name -> exact value at the wanted rank (None where the column has no rows)."""
    pending = [w for w in wanted if w.rows > 0]
    while True:
        large = [w for w in pending if w.answer is None and w.rows > final_rows]
        if not large:
            break
        _narrow(df, large, _probe(df, large))
    small = [w for w in pending if w.answer is None]
    if small:
        _read_off(df, small)
    return {w.name: w.answer for w in wanted}
