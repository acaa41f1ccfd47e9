"""Comparison of two prediction sets that moves rows only where the sets differ.

Rows are dealt to ranges of a hash of their id.  Each range has an order-free fingerprint, sums of two
64-bit hashes of its rows, added for one side and subtracted for the other, so that a range is
equal when count and sums are zero.  Ranges that differ are cut into finer ones, and only the rows
of the finest that still differ are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.operators.ensemble import alignment_report
from lexgrain.session import kept_table

#: Bits of the range number, level by level.
LEVELS = (12, 24, 36)


def _signed_rows(a: DataFrame, b: DataFrame, id: str, label: str) -> DataFrame:
    """Rows of both sides with one type for ids and labels, ``_sign`` 1 for a and -1 for b."""
    sides = [
        side.select(F.col(id).alias("_id"), F.col(label).alias("_label"), F.lit(sign).alias("_sign"))
        for side, sign in ((a, 1), (b, -1))
    ]
    return sides[0].unionByName(sides[1])


def _range_number(bits: int) -> Column:
    """The first bits of the id's hash; ids of one value are in one range at every level."""
    return F.shiftrightunsigned(F.xxhash64("_id", F.col("_id").isNull()), 64 - bits)


def _row_hash(seed: int) -> Column:
    """A hash of id and label; a null is told from every value."""
    nulls = [F.col(c).isNull() for c in ("_id", "_label")]
    return F.xxhash64(F.lit(seed), "_id", "_label", *nulls).cast("decimal(20,0)") * F.col("_sign")


def _differing_ranges(rows: DataFrame, bits: int) -> DataFrame:
    """Ranges whose rows differ.  What is shuffled is one row for each task and range."""
    sums = rows.groupBy(_range_number(bits).alias("_range")).agg(
        F.sum("_sign").alias("_rows"), F.sum(_row_hash(1)).alias("_first"), F.sum(_row_hash(2)).alias("_second")
    )
    differs = [F.col(c) != 0 for c in ("_rows", "_first", "_second")]
    return sums.where(reduce(Column.__or__, differs)).select("_range")


def differing_rows(
    a: DataFrame, b: DataFrame, id: str = "id", label: str = "label", levels: tuple[int, ...] = LEVELS
) -> DataFrame:
    """``(_id, _label, _sign)`` of the rows in ranges that differ, all rows of an id together.

    The ranges of each level are written to the shared folder; both inputs are read once a level.
    """
    every = _signed_rows(a, b, id, label)
    rows = every
    for bits in levels:
        ranges = kept_table(_differing_ranges(rows, bits), "ranges")
        rows = every.join(ranges, _range_number(bits) == F.col("_range"), "left_semi")
        if ranges.isEmpty():
            break
    return rows


def reconciliation_report(
    a: DataFrame,
    b: DataFrame,
    id: str = "id",
    label: str = "label",
    unique_ids: bool = False,
    levels: tuple[int, ...] = LEVELS,
) -> DataFrame:
    """The row of ``ensemble.alignment_report``, from the rows of differing ranges.

    ``n_ids`` counts every id.  With ``unique_ids`` no id is repeated within a side, so in equal ranges
    rows are counted and nothing else moves; without it the ids of one side of these are counted apart.
    Null ids are one id, and labels are compared as multisets.
    """
    rows = kept_table(differing_rows(a, b, id, label, levels), "differing")
    sides = [rows.where(F.col("_sign") == sign) for sign in (1, -1)]
    report = alignment_report(*sides, "_id", "_label")
    ids = a.select(F.col(id).alias("_id"))
    if unique_ids:
        equal = ids.agg(F.count("*").alias("n")).first()["n"] - sides[0].count()
    else:
        # The differing ranges hold all rows of their ids, so an id in them is nowhere else.
        counted = ids.distinct().agg(F.count("*").alias("n")).first()["n"]
        equal = counted - sides[0].select("_id").distinct().count()
    return report.withColumn("n_ids", F.col("n_ids") + F.lit(equal))
