"""Vocabulary sizes and overlaps from stored sketches; the texts are read once, ever.

A theta sketch keeps the smallest hash values of a set.  Sketches of parts are merged into the sketch
of the whole, and unions, intersections and differences are estimated from them.  One holds at most
``2 ** log_size`` values, up to which it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.functions.text import whitespace_tokens

LOG_SIZE = 16


def vocabulary_sketches(
    df: DataFrame, by: tuple[str, ...] = ("label",), text: str = "sentence", log_size: int = LOG_SIZE
) -> DataFrame:
    """``(by..., sketch, total_words)``: words of each group; no word is shuffled, only sketches.

    Groups without a word, and null texts, have no row.
    """
    words = df.select(*by, F.explode(whitespace_tokens(F.col(text))).alias("word"))
    return words.groupBy(*by).agg(
        F.theta_sketch_agg("word", log_size).alias("sketch"), F.count("*").alias("total_words")
    )


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Add the sketches of new texts to a folder; those of earlier texts stay as they are."""
    sketches.write.mode("append").parquet(path)


def merged_sketches(
    sketches: DataFrame, by: tuple[str, ...] = ("label",), log_size: int = LOG_SIZE
) -> DataFrame:
    """One sketch for each group of ``by``, from sketches of parts."""
    return sketches.groupBy(*by).agg(
        F.theta_union_agg("sketch", log_size).alias("sketch"), F.sum("total_words").alias("total_words")
    )


def sketched_sizes(merged: DataFrame, by: tuple[str, ...] = ("label",), log_size: int = LOG_SIZE) -> DataFrame:
    """``(by..., unique_words, total_words, bound)``.

    The estimate is off by at most ``bound`` at three standard deviations; 0 where it is exact.
    """
    size = F.theta_sketch_estimate("sketch")
    return merged.select(*by, size.alias("unique_words"), "total_words", _bound(size, log_size).alias("bound"))


def sketched_overlap(
    merged: DataFrame, label: str = "label", first: int = 0, second: int = 1, log_size: int = LOG_SIZE
) -> DataFrame:
    """``(only_first, only_second, shared, bound)`` of the words under two labels, as one row.

    The sketches of two groups meet in one row.  A label without a sketch has no words; the bound is
    that of the union and holds for each of the three numbers.
    """
    none = F.theta_sketch_agg(F.lit(None).cast("string"), log_size)
    sides = merged.agg(
        F.coalesce(F.max(F.when(F.col(label) == first, F.col("sketch"))), none).alias("a"),
        F.coalesce(F.max(F.when(F.col(label) == second, F.col("sketch"))), none).alias("b"),
    )
    return sides.select(
        F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("only_first"),
        F.theta_sketch_estimate(F.theta_difference("b", "a")).alias("only_second"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("shared"),
        _bound(F.theta_sketch_estimate(F.theta_union("a", "b", log_size)), log_size).alias("bound"),
    )


def _bound(union, log_size: int):
    """Three standard deviations of an estimated part of a union: the kept values are a uniform sample."""
    size = 1 << log_size
    spread = 3.0 / (size - 2) ** 0.5
    return F.when(union <= size, F.lit(0)).otherwise(F.ceil(union * F.lit(spread))).cast("bigint")
