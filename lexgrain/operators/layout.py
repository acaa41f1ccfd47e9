"""Partitioning helpers and exact global numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.session import kept_table


def _running_starts(counts: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """``(keys..., _n, _start)``, rows with smaller keys, and whether any key stands twice.

    The counted keys are range-partitioned and sorted in parallel.  Writing them to the shared
    folder fixes the ranges, so a lost executor cannot move keys between them; the number of its
    range is written beside a key.  The rows of each range, one number per partition, then give
    where the range starts, and a running sum inside the range does the rest.
    """
    ranged = counts.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    ranged = kept_table(ranged, "key-ranges")
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"))
    before, total, ties = {}, 0, False
    for row in sorted(sizes.collect()):  # bounded: one row per partition
        before[row["_range"]] = total
        total += row["_rows"]
        ties |= row["_most"] > 1
    listed = ",".join(str(before.get(r, 0)) for r in range(max(before, default=0) + 1))
    lookup = F.split(F.lit(listed), ",").cast("array<bigint>")
    smaller = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_n").over(smaller), F.lit(0))
    starts = ranged.withColumn("_start", F.get(lookup, F.col("_range")) + inside).drop("_range")
    return starts, ties


def _place_among_equal(tied: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_place``: 0, 1, ... among the rows of equal keys, in any order.

    The written rows stay in their parts, so a key with a large share of all rows is numbered part
    by part; the counts of its parts, not its rows, meet to say where each part starts.
    """
    dealt = tied.withColumn("_part", F.spark_partition_id())
    dealt = kept_table(dealt.withColumn("_mark", F.monotonically_increasing_id()), "tied")
    parts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    parts = parts.withColumnsRenamed({k: f"{k}_of_part" for k in keys} | {"_part": "_its_part"})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of_part")) for k in keys]
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_mark")) - 1
    numbered = dealt.withColumn("_own", own)
    on = reduce(Column.__and__, same, F.col("_part") == F.col("_its_part"))
    return numbered.join(parts, on).withColumn("_place", F.col("_before") + F.col("_own"))


def with_positions(df: DataFrame, order: list[str | Column], position: str = "id") -> DataFrame:
    """Number all rows 0..n-1 in the given ascending order; nulls come first, ties in any order.

    Only the order columns are counted, ranged and sorted.  The other columns, texts among them,
    move once: in the join that brings each row its key's number.  ``df`` is read twice, so its
    order columns must not change between reads; names or expressions may be given, no directions.
    Rows with equal keys are numbered among themselves afterwards.  An input column named
    ``position`` is replaced.
    """
    named = {f"_key{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    keys = list(named)
    counts = df.select(*[c.alias(k) for k, c in named.items()]).groupBy(*keys)
    starts, ties = _running_starts(counts.agg(F.count("*").alias("_n")), keys)
    found = starts.withColumnsRenamed({k: f"{k}_of" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    placed = df.withColumns(named).join(found, reduce(Column.__and__, same))
    placed = placed.drop(*[f"{k}_of" for k in keys])
    kept = [F.col(c) for c in df.columns if c != position]
    single = placed.where("_n = 1").select(*kept, F.col("_start").alias(position))
    if not ties:
        return single
    tied = _place_among_equal(placed.where("_n > 1"), keys)
    return single.unionByName(tied.select(*kept, (F.col("_start") + F.col("_place")).alias(position)))
