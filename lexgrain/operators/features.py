"""Row-wise text features and their population standardisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.functions import charclasses as cc
from lexgrain.functions import text as tx
from lexgrain.functions.scores import safe_ratio

# The statistical features and their order in a feature vector.
FEATURES = [
    "char_count",
    "word_count",
    "avg_word_len",
    "punctuation",
    "punctuation_ratio",
    "upper_ratio",
    "digit_ratio",
    "space_ratio",
]


def with_cleaned(df: DataFrame, text: str = "sentence") -> DataFrame:
    return df.withColumn(text, tx.clean_text(F.col(text)))


def with_text_features(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Add the eight statistical features of ``text``.

    One collapsing pass serves both word and space counts: in the collapsed text words are
    separated by exactly one space.  Other classes are counted by deleting their complement, which
    matches a few long runs rather than many single characters.
    """
    raw = F.col(text)
    counted = (
        df.withColumn("_flat", tx.collapse_spaces(raw))
        .withColumn("_solid", F.length(F.replace("_flat", F.lit(" "), F.lit(""))).cast("bigint"))
        .withColumn("char_count", F.length(raw).cast("bigint"))
        .withColumn(
            "word_count",
            F.when(F.col("_solid") == 0, F.lit(0).cast("bigint")).otherwise(
                F.length("_flat") - F.col("_solid") + 1
            ),
        )
        .withColumn(
            "punctuation",
            F.length(F.regexp_replace(raw, f"{cc.NOT_PUNCTUATION}+", "")).cast("bigint"),
        )
        .withColumn("_upper", F.length(F.regexp_replace(raw, f"{cc.NOT_UPPER_JAVA}+", "")))
        .withColumn("_digit", F.length(F.regexp_replace(raw, f"{cc.NOT_DIGIT_JAVA}+", "")))
    )
    chars = F.col("char_count")
    kept = [F.col(c) for c in df.columns if c not in FEATURES]
    return counted.select(
        *kept,
        chars,
        F.col("word_count"),
        safe_ratio(F.col("_solid"), F.col("word_count")).alias("avg_word_len"),
        F.col("punctuation"),
        safe_ratio(F.col("punctuation"), chars).alias("punctuation_ratio"),
        safe_ratio(F.col("_upper"), chars).alias("upper_ratio"),
        safe_ratio(F.col("_digit"), chars).alias("digit_ratio"),
        safe_ratio(chars - F.col("_solid"), chars).alias("space_ratio"),
    )


def with_word_count(df: DataFrame, text: str = "sentence", out: str = "word_count") -> DataFrame:
    """Number of whitespace-separated words, without building a token array."""
    flat = tx.collapse_spaces(F.col(text))
    return (
        df.withColumn("_flat", flat)
        .withColumn("_solid", F.length(F.replace("_flat", F.lit(" "), F.lit(""))))
        .withColumn(
            out,
            F.when(F.col("_solid") == 0, F.lit(0))
            .otherwise(F.length("_flat") - F.col("_solid") + 1)
            .cast("bigint"),
        )
        .drop("_flat", "_solid")
    )


def scaler_statistics(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Mean and population standard deviation, one row per feature."""
    wide = df.agg(
        *[
            F.struct(F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")).alias(f)
            for f in features
        ]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.col(f"{f}.mean").alias("mean"),
                        F.col(f"{f}.std").alias("std"),
                    )
                    for f in features
                ]
            )
        )
    )


@dataclass(frozen=True)
class Scaler:
    """Fitted means and population deviations; a constant feature is divided by one."""

    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str] = FEATURES) -> Scaler:
        rows = scaler_statistics(df, features).collect()  # one row per feature
        return cls(
            {r["feature"]: r["mean"] for r in rows},
            {r["feature"]: r["std"] for r in rows},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f: (F.col(f) - F.lit(self.means[f])) / F.lit(self.stds[f] or 1.0)
                for f in self.means
            }
        )
