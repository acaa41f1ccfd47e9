"""Exact quantiles of continuous columns, without sorting or holding the values.

Lengths are few distinct integers, so their quantiles come from value counts (``profile``).  A ratio
has about as many values as rows.  Here every wanted order statistic gets a bracket of two values
that surely holds it.  A pass over the narrow columns counts exactly what lies below, on and inside
the bracket and sketches the inside; the sketch proposes a narrower bracket, and the counts of the
next pass decide whether it holds.  Once few rows are inside, their value counts give the answer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexgrain.session import kept_table

# Cells of the sketch's grid; its rank error (rows / ACCURACY) is far below one cell.
GRID = 256
ACCURACY = 10_000
# More brackets than this are joined by Spark's choice instead of being broadcast.
BROADCAST_BRACKETS = 10_000


@dataclass
class _Bracket:
    """The value of one rank (from 0) of a group lies in the closed range ``low``..``high``."""

    group: tuple
    rank: int
    low: float
    high: float
    last: tuple[float, float] | None = None
    value: float | None = None
    place: int = -1

    def narrow(self, row, at_most: int) -> None:
        """Use the exact counts of a pass: answer, or take the part that holds the rank."""
        place = self.rank - row["below"]
        if place < 0:  # the sketch erred: the value is left of the bracket
            self.low, self.high = self.last[0], self.low
        elif place < row["on_low"]:
            self.value = self.low
        elif place < row["on_low"] + row["inside"]:
            self.place = place - row["on_low"]
            if row["inside"] > at_most:
                cell = self.place * GRID // row["inside"]
                self.last, self.place = (self.low, self.high), -1
                self.low = row["grid"][max(cell - 1, 0)]
                self.high = row["grid"][min(cell + 2, GRID)]
        elif place < row["on_low"] + row["inside"] + row["on_high"]:
            self.value = self.high
        else:
            self.low, self.high = self.high, self.last[1]


def _bracket_table(df: DataFrame, by: list[str], brackets: dict[int, _Bracket]) -> DataFrame:
    fields = [df.schema[c] for c in by]
    schema = StructType(
        [StructField(f"_g{i}", f.dataType) for i, f in enumerate(fields)]
        + [StructField("_no", LongType()), StructField("_low", DoubleType())]
        + [StructField("_high", DoubleType())]
    )
    rows = [(*b.group, no, b.low, b.high) for no, b in brackets.items()]
    table = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_BRACKETS else table


def _bracketed(df: DataFrame, by: list[str], brackets: dict[int, _Bracket]) -> DataFrame:
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(_bracket_table(df, by, brackets), on)


def _pass(df: DataFrame, by: list[str], brackets: dict[int, _Bracket], at_most: int) -> None:
    value, low, high = F.col("value"), F.col("_low"), F.col("_high")
    inside = (value > low) & (value < high)
    grid = [i / GRID for i in range(GRID + 1)]
    counted = (
        _bracketed(df, by, brackets)
        .groupBy("_no")
        .agg(
            F.count_if(value < low).alias("below"),
            F.count_if(value == low).alias("on_low"),
            F.count_if(inside).alias("inside"),
            F.count_if((value == high) & (high > low)).alias("on_high"),
            F.percentile_approx(F.when(inside, value), grid, ACCURACY).alias("grid"),
        )
    )
    for row in counted.collect():  # one row a bracket
        brackets[row["_no"]].narrow(row, at_most)


def _finish(df: DataFrame, by: list[str], brackets: dict[int, _Bracket]) -> None:
    """Take the values of brackets with few rows from their value counts."""
    inside = (F.col("value") > F.col("_low")) & (F.col("value") < F.col("_high"))
    counts = _bracketed(df, by, brackets).where(inside).groupBy("_no", "value")
    # At most ``at_most`` distinct values of a bracket reach this window.
    smaller = Window.partitionBy("_no").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.agg(F.count("*").alias("n")).withColumn(
        "first", F.coalesce(F.sum("n").over(smaller), F.lit(0))
    )
    places = F.create_map(*[F.lit(v) for no, b in brackets.items() for v in (no, b.place)])
    place = F.element_at(places, F.col("_no").cast("int"))
    found = ranked.where((F.col("first") <= place) & (place < F.col("first") + F.col("n")))
    for row in found.collect():  # one row a bracket
        brackets[row["_no"]].value = row["value"]


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    by: tuple[str, ...] = (),
    at_most: int = 100_000,
) -> DataFrame:
    """``(by..., metric, probability, n, value)`` by linear interpolation, as ``percentile`` gives.

    Nulls and NaN are left out; a group or column without values has no rows, null is a group of
    its own.  The narrow columns are written once to the shared folder, so what they are computed
    from is read once.  A pass leaves at most about 3 / 256 of a bracket's rows inside, and
    ``at_most`` bounds the rows that are looked at one by one.  The driver holds two brackets per
    group, column and probability: ``by`` is meant for labels, not for ids.
    """
    spark = df.sparkSession
    keys = [f"_by{i}" for i in range(len(by))]
    wide = df.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)],
        *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in columns],
    )
    stacked = wide.unpivot(keys, columns, "metric", "value")
    groups = [*keys, "metric"]
    values = kept_table(stacked, "quantile-values").where("value is not null and not isnan(value)")
    ends = values.groupBy(*groups).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    wanted, brackets = [], {}
    for row in ends.collect():  # one row a group and column
        group = tuple(row[g] for g in groups)
        for p in probabilities:
            at = p * (row["n"] - 1)
            numbers = []
            for rank in sorted({math.floor(at), math.ceil(at)}):
                numbers.append(len(brackets))
                brackets[len(brackets)] = _Bracket(group, rank, row["low"], row["high"])
            wanted.append((group, float(p), row["n"], at - math.floor(at), numbers))
    while todo := {no: b for no, b in brackets.items() if b.value is None and b.place < 0}:
        _pass(values, groups, todo, at_most)
    if few := {no: b for no, b in brackets.items() if b.value is None}:
        _finish(values, groups, few)
    rows = []
    for group, p, n, part, numbers in wanted:
        lower, upper = brackets[numbers[0]].value, brackets[numbers[-1]].value
        rows.append((*group, p, n, lower + part * (upper - lower)))
    schema = StructType(
        [StructField(c, df.schema[c].dataType) for c in by]
        + [values.schema["metric"], StructField("probability", DoubleType())]
        + [StructField("n", LongType()), StructField("value", DoubleType())]
    )
    return spark.createDataFrame(rows, schema)
