"""Exact interpolated quantiles of many columns by selection.

No task and no driver ever holds the distinct values of a column. A first histogram has buckets in proportion to the
value (`STEPS` to an octave, signs apart), so it needs to know nothing of the data; it tells for each wanted rank the
bucket that holds it, with that bucket's own least and greatest value. Buckets with many rows are cut into equal parts
again and again, all columns and ranks in the same pass; the values of what is left come to the driver, counted by value
and `FEW` rows in all at most. A bucket whose least and greatest value are equal is done, however many rows it has."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, PARTS, FEW = 32, 1024, 200_000
#: More than the steps from 1 down to the least double.
_SHIFT = 40_000


@dataclass(frozen=True)
class Bracket:
    """A range of values of a column: `below` rows are less than `low`, `rows` are in it."""

    column: int
    low: float
    high: float
    below: int
    rows: int


def _octaves(v: Column) -> Column:
    """A bucket number that never falls as v grows; infinities have their own."""
    size = F.when(F.abs(v) == float("inf"), 2 * _SHIFT + 1).otherwise(F.floor(F.log2(F.abs(v)) * STEPS).cast("int") + _SHIFT)
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size)


def _holding(found: dict, wanted: dict[int, set[int]], below: dict) -> dict[tuple[int, int], Bracket]:
    """The bracket of each (column, rank) from histograms by column: (bucket, rows, least, greatest) in order."""
    out = {}
    for (column, *_), buckets in found.items():
        at = below[column]
        for _, n, low, high in sorted(buckets):
            for rank in wanted[column]:
                if at <= rank < at + n:
                    out[column, rank] = Bracket(column, low, high, at, n)
            at += n
    return out


def quantiles(df: DataFrame, columns: dict[str, Column], at: list[float], few: int = FEW, parts: int = PARTS, times: dict[str, Column] | None = None) -> dict[str, list[float | None]]:
    """The values at the shares `at` of every column, between neighbours in proportion; nulls and NaN don't count, and a
    column without values has none. times: how many equal rows a row stands for, by column (one without)."""
    names = list(columns)
    number = [(times or {}).get(n, F.lit(1)).cast("long") for n in names]
    values = [F.struct(F.lit(i).alias("c"), F.when(~F.isnan(x) & (number[i] > 0), x).alias("v"), number[i].alias("m")) for i, x in enumerate(c.cast("double") for c in columns.values())]
    long = df.select(F.explode(F.array(*values)).alias("x")).select("x.*").where("v IS NOT NULL")
    first: dict = {}
    for r in long.groupBy("c", _octaves(F.col("v")).alias("b")).agg(F.sum("m").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        first.setdefault((r["c"],), []).append((r["b"], r["n"], r["low"], r["high"]))
    sizes = {c: sum(n for _, n, _, _ in buckets) for (c,), buckets in first.items()}
    ranks = {c: {r for a in at for r in (math.floor(a * (n - 1)), math.ceil(a * (n - 1)))} for c, n in sizes.items()}
    held = _holding(first, ranks, dict.fromkeys(sizes, 0))

    def open_brackets() -> list[Bracket]:
        return sorted({b for b in held.values() if b.low < b.high}, key=lambda b: (b.column, b.below))

    while (open_ := open_brackets()) and sum(b.rows for b in open_) > few:
        cut = [b for b in open_ if b.rows > few // len(open_)]
        inside = [_in_bracket(columns[names[b.column]], number[b.column], b, i, parts) for i, b in enumerate(cut)]
        again = df.select(F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("x")).select("x.*")
        finer: dict = {}
        for r in again.groupBy("i", "b").agg(F.sum("m").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            finer.setdefault(r["i"], []).append((r["b"], r["n"], r["low"], r["high"]))
        for i, b in enumerate(cut):
            if sum(n for _, n, _, _ in finer.get(i, [])) != b.rows:
                raise RuntimeError("the rows changed between two passes")
            mine = {r for (c, r), x in held.items() if x == b}
            held |= _holding({(b.column,): finer[i]}, {b.column: mine}, {b.column: b.below})
    exact = {(c, r): b.low for (c, r), b in held.items() if b.low == b.high}
    if open_ := open_brackets():
        inside = [_in_bracket(columns[names[b.column]], number[b.column], b, i, 1) for i, b in enumerate(open_)]
        last: dict[int, list] = {}
        for r in df.select(F.explode(F.filter(F.array(*inside), lambda s: s.isNotNull())).alias("x")).select("x.*").groupBy("i", "v").agg(F.sum("m").alias("n")).collect():
            last.setdefault(r["i"], []).append((r["v"], r["n"]))
        for i, b in enumerate(open_):
            found = _holding({(b.column,): [(v, n, v, v) for v, n in last.get(i, [])]}, {b.column: {r for (c, r), x in held.items() if x == b}}, {b.column: b.below})
            exact |= {k: x.low for k, x in found.items()}
    out: dict[str, list[float | None]] = {n: [None] * len(at) for n in names}
    for c, n in sizes.items():
        for k, a in enumerate(at):
            low, high = exact[c, math.floor(a * (n - 1))], exact[c, math.ceil(a * (n - 1))]
            out[names[c]][k] = low if low == high else low + (high - low) * (a * (n - 1) - math.floor(a * (n - 1)))
    return out


def _in_bracket(value: Column, times: Column, b: Bracket, i: int, parts: int) -> Column:
    """struct(bracket, part of it, value, number) of a row within the bracket, else null."""
    v = value.cast("double")
    part = F.least(F.floor((v - b.low) / (b.high - b.low) * parts), F.lit(parts - 1)).cast("int") if parts > 1 else F.lit(0)
    return F.when((v >= b.low) & (v <= b.high) & ~F.isnan(v) & (times > 0), F.struct(F.lit(i).alias("i"), part.alias("b"), v.alias("v"), times.alias("m")))
