"""Deterministic stratified folds and hold-outs.

Rows are ordered by a hash of their id, so a split depends on ids and seed alone and survives
re-execution.  The hash prefix cuts every class into buckets of similar size: ranks are computed
inside buckets and shifted by bucket totals, so a class with most of the rows is sorted by many
tasks.  An id identifies one row.  Pass ``(id, label)`` only and join the result to wide data by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, id: str, seed: int, hex_digits: int) -> DataFrame:
    hashed = F.md5(F.concat(F.col(id).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_hash", hashed).withColumn(
        "_bucket", F.substring("_hash", 1, hex_digits)
    )


def _bucket_starts(keyed: DataFrame, label: str) -> DataFrame:
    """``(label, _bucket, _start)``: rows in smaller labels and in earlier buckets of the label.

    At most ``16 ** hex_digits`` rows per class reach the ordered window.
    """
    sizes = keyed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(label, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _position(keyed: DataFrame, starts: DataFrame, id: str, label: str) -> DataFrame:
    """Add ``_pos``, the 1-based place of a row in (label, hash, id) order over all rows.

    Ranking and join use the same keys, so the ranked side is shuffled once even if the starts
    are too large to broadcast.
    """
    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_hash", id)
    return (
        keyed.withColumn("_row", F.row_number().over(in_bucket))
        .join(starts, [label, "_bucket"], "left")
        .withColumn("_pos", F.col("_start") + F.col("_row"))
    )


def stratified_kfold(
    df: DataFrame,
    id: str = "id",
    label: str = "label",
    k: int = 5,
    seed: int = 42,
    fold: str = "fold",
    hex_digits: int = 3,
) -> DataFrame:
    """Add a fold number 0..k-1; the rows of a class differ by at most one between folds."""
    keyed = _bucketed(df, id, seed, hex_digits)
    placed = _position(keyed, _bucket_starts(keyed, label), id, label)
    return placed.select(
        *df.columns, F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int").alias(fold)
    )


def _test_quotas(starts: DataFrame, label: str, test_size: float) -> DataFrame:
    """``(label, _last)``: place of the last test row of each class.

    The classes share ``ceil(test_size * n)`` rows by largest remainder; equal remainders go to
    the smaller label.  One row per class reaches the windows.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    classes = starts.groupBy(label).agg(F.sum("_n").alias("_c"), F.min("_start").alias("_first"))
    shares = (
        classes.withColumn("_total", F.sum("_c").over(everything))
        .withColumn("_wanted", F.ceil(F.lit(float(test_size)) * F.col("_total")))
        .withColumn("_base", F.expr("(_c * _wanted) div _total"))
        .withColumn("_rest", F.expr("(_c * _wanted) % _total"))
        .withColumn("_left", F.col("_wanted") - F.sum("_base").over(everything))
        .withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_rest"), F.asc(label))))
    )
    extra = F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
    return shares.select(label, (F.col("_first") + F.col("_base") + extra).alias("_last"))


def stratified_holdout(
    df: DataFrame,
    id: str = "id",
    label: str = "label",
    test_size: float = 0.2,
    seed: int = 42,
    out: str = "is_test",
    hex_digits: int = 3,
) -> DataFrame:
    """Mark ``ceil(test_size * n)`` rows, shared over the classes by largest remainder."""
    keyed = _bucketed(df, id, seed, hex_digits)
    starts = _bucket_starts(keyed, label)
    starts = starts.join(_test_quotas(starts, label, test_size), label)
    placed = _position(keyed, starts.drop("_n"), id, label)
    return placed.select(*df.columns, (F.col("_pos") <= F.col("_last")).alias(out))


def fold_train(df: DataFrame, held_out: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) != held_out)


def fold_validation(df: DataFrame, held_out: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) == held_out)


def select_ids(df: DataFrame, ids: DataFrame, id: str = "id", keep: bool = True) -> DataFrame:
    """Rows whose id is (or, with ``keep=False``, is not) listed in ``ids``."""
    return df.join(ids.select(id), id, "left_semi" if keep else "left_anti")
