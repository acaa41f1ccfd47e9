"""Corpus profiling: label balance, lengths, vocabulary and chart data.

Length statistics are computed from ``value -> rows`` counts.  There are only as many distinct
lengths as the longest text has characters, so the exact percentiles behind them see a small table
however large the corpus is, and a class with most of the rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as tx
from lexgrain.functions.scores import percentage
from lexgrain.operators.features import with_text_features, with_word_count


def label_distribution(
    df: DataFrame, label: str = "label", classes: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """Rows and percentage per label; expected ``classes`` without rows are listed with zero."""
    label_type = df.schema[label].dataType
    expected = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c).cast(label_type) for c in classes])).alias(label),
        F.lit(0).cast("bigint").alias("n"),
    )
    counts = (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .unionByName(expected)
        .groupBy(label)
        .agg(F.sum("n").alias("n"))
    )
    # One row per class reaches this window.
    whole = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumn("pct", percentage(F.col("n"), whole))


def value_counts(df: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """``(by..., metric, value, n)`` for several integer columns in one scan."""
    if len(values) == 1:
        keys = [F.lit(values[0]).alias("metric"), F.col(values[0]).cast("bigint").alias("value")]
        return df.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    long = df.unpivot(
        [F.col(b) for b in by], [F.col(v).cast("bigint").alias(v) for v in values], "metric", "value"
    )
    return long.groupBy(*by, "metric", "value").agg(F.count("*").alias("n"))


def word_length_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """``(label, value, n)``: rows per word count.

    Null texts are dropped on the stored column; the same test on the derived count would be
    pushed below the projection and evaluate its expressions once more.
    """
    rows = df.select(label, text).where(F.col(text).isNotNull())
    return value_counts(with_word_count(rows, text, "words"), ["words"], [label]).drop("metric")


def summarise_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, population deviation, minimum and maximum from value counts."""
    group = Window.partitionBy(*by)
    total = F.sum("n").over(group)
    mean = F.sum(F.col("value") * F.col("n")).over(group) / total
    return (
        counts.withColumn("_mean", mean)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            F.first("_mean").alias("mean"),
            F.percentile("value", 0.5, F.col("n")).alias("median"),
            F.sqrt(
                F.sum(F.col("n") * F.pow(F.col("value") - F.col("_mean"), 2)) / F.sum("n")
            ).alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def length_profile(
    df: DataFrame, text: str = "sentence", metrics: tuple[str, ...] = ("chars", "words")
) -> DataFrame:
    """Distribution of text lengths in characters and words."""
    source = df.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    if "words" in metrics:
        source = with_word_count(source, "_text", "words")
    if "chars" in metrics:
        source = source.withColumn("chars", F.length("_text"))
    return summarise_counts(value_counts(source, list(metrics), []), ["metric"])


def stats_by_label(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Counts, length statistics, punctuation and upper-case share per label, in one pass."""
    return (
        with_text_features(df.select(label, text), text)
        .groupBy(label)
        .agg(
            F.count("*").alias("n"),
            F.avg("word_count").alias("word_mean"),
            F.stddev_pop("word_count").alias("word_std"),
            F.avg("char_count").alias("char_mean"),
            F.stddev_pop("char_count").alias("char_std"),
            F.avg("punctuation").alias("punct_mean"),
            F.avg("upper_ratio").alias("upper_ratio_mean"),
        )
    )


def feature_means_long(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """``(label, metric, value)`` with mean words, punctuation and upper-case share in percent."""
    means = (
        with_text_features(df.select(label, text), text)
        .groupBy(label)
        .agg(
            F.avg("word_count").alias("word_count"),
            F.avg("punctuation").cast("double").alias("punctuation"),
            (F.avg("upper_ratio") * 100).alias("upper_ratio"),
        )
    )
    return means.unpivot([label], ["word_count", "punctuation", "upper_ratio"], "metric", "value")


def word_histogram(
    df: DataFrame, text: str = "sentence", label: str = "label", bins: int = 30
) -> DataFrame:
    """Word counts per label in equal bins over the combined range; empty bins are listed.

    Bins are closed on the left, the last one on both sides.  If all values are equal the range
    is widened by one half on each side.
    """
    counts = word_length_counts(df, text, label)
    # Without the sum Spark would drop the grouping below min and max and read the texts twice.
    span = counts.select(
        F.struct(
            F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n")
        ).alias("span")
    ).scalar()
    half = F.when(F.col("span.lo") == F.col("span.hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    placed = (
        counts.withColumn("span", span)
        .withColumn("lo", F.col("span.lo") - half)
        .withColumn("hi", F.col("span.hi") + half)
        .withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(bins))
        .withColumn("guess", F.floor((F.col("value") - F.col("lo")) / F.col("step")).cast("int"))
    )

    def edge(i):
        return F.when(i >= bins, F.col("hi")).otherwise(i * F.col("step") + F.col("lo"))

    # Floating-point edges decide membership, so the arithmetic guess may be off by one.
    guess = F.col("guess")
    fixed = guess + F.when(F.col("value") < edge(guess), -1).when(
        F.col("value") >= edge(guess + 1), 1
    ).otherwise(0)
    placed = placed.withColumn("bin", F.least(fixed, F.lit(bins - 1)))
    per_bin = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("bin"),
            F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).alias("n"),
        )
        for i in range(bins)
    ]
    return (
        placed.groupBy(label)
        .agg(F.first("lo").alias("_lo"), F.first("step").alias("_step"), F.first("hi").alias("_hi"),
             F.array(*per_bin).alias("bins"))
        .select(label, "_lo", "_step", "_hi", F.inline("bins"))
        .select(
            label,
            "bin",
            ((F.col("bin") - 1) * F.col("_step") + F.col("_lo")).alias("bin_low"),
            F.when(F.col("bin") == bins, F.col("_hi"))
            .otherwise(F.col("bin") * F.col("_step") + F.col("_lo"))
            .alias("bin_high"),
            "n",
        )
    )


def _fenced_counts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Word length counts with the quartiles, mean and fences of their label.

    The window sees one row per distinct length of a label.
    """
    group = Window.partitionBy(label)
    n, value = F.col("n"), F.col("value")
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    return (
        word_length_counts(df, text, label)
        .withColumn("_q", F.percentile("value", [0.25, 0.5, 0.75], n).over(group))
        .withColumn("n_rows", F.sum("n").over(group))
        .withColumn("mean", F.sum(value * n).over(group) / F.col("n_rows"))
        .select(
            label,
            "value",
            "n",
            "n_rows",
            "mean",
            q1.alias("q1"),
            F.col("_q")[1].alias("median"),
            q3.alias("q3"),
            (q1 - 1.5 * (q3 - q1)).alias("fence_low"),
            (q3 + 1.5 * (q3 - q1)).alias("fence_high"),
        )
    )


def box_stats(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Quartiles, mean, whiskers and outlier count of word counts per label."""
    value, n = F.col("value"), F.col("n")
    inside_low = F.min(F.when(value >= F.col("fence_low"), value))
    inside_high = F.max(F.when(value <= F.col("fence_high"), value))
    outlier = (value < F.col("fence_low")) | (value > F.col("fence_high"))
    return (
        _fenced_counts(df, text, label)
        .groupBy(label)
        .agg(
            F.sum(n).alias("n"),
            *[F.first(c).alias(c) for c in ("mean", "q1", "median", "q3")],
            F.least(inside_low, F.first("q1")).alias("whisker_low"),
            F.greatest(inside_high, F.first("q3")).alias("whisker_high"),
            F.coalesce(F.sum(F.when(outlier, n)), F.lit(0)).alias("n_outliers"),
        )
    )


def box_outliers(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Word counts beyond the whiskers, each with its number of rows."""
    value = F.col("value")
    return (
        _fenced_counts(df, text, label)
        .where((value < F.col("fence_low")) | (value > F.col("fence_high")))
        .select(label, "value", "n")
    )


def _words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(tx.whitespace_tokens(F.col(text))).alias("word"))


def vocab_totals(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Distinct words, all words and words per sentence; sentences without words count too.

    An empty sentence yields one null word, so counting first positions counts sentences and a
    single scan and shuffle answer all three.
    """
    words = (
        df.where(F.col(text).isNotNull())
        .select(F.posexplode_outer(tx.whitespace_tokens(F.col(text))).alias("pos", "word"))
        .groupBy("word")
        .agg(
            F.count("word").alias("c"),
            F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("starts"),
        )
    )
    return words.agg(
        F.count("word").alias("unique_words"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_words"),
        F.try_divide(F.sum("c").cast("double"), F.sum("starts")).alias("words_per_sentence"),
    )


def approximate_vocab_size(df: DataFrame, text: str = "sentence", rsd: float = 0.01) -> DataFrame:
    """Estimate of the distinct words without shuffling them; an explicit alternative."""
    return _words(df, text).agg(F.approx_count_distinct("word", rsd).alias("unique_words"))


def vocab_by_label(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Distinct words per label."""
    return (
        _words(df, text, label).distinct().groupBy(label).agg(F.count("*").alias("unique_words"))
    )


def top_words(df: DataFrame, text: str = "sentence", id: str = "id", k: int = 20) -> DataFrame:
    """The ``k`` most frequent words with their share; ties in order of first appearance.

    The first appearance of integer ids is packed into one decimal (row id above, token position
    below), which keeps the aggregation hash-based; other ids take a struct minimum.  The total is
    the sum over the grouped words, so texts are read and tokenised once.
    """
    source = df.where(F.col(text).isNotNull())
    if df.schema[id].dataType.typeName() in ("byte", "short", "integer", "long"):
        base = F.col(id).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")
        first = F.min(F.col("_base") + F.col("pos"))
    else:
        base = F.col(id)
        first = F.min(F.struct("_base", "pos"))
    tokens = source.select(
        base.alias("_base"), F.posexplode(tx.whitespace_tokens(F.col(text))).alias("pos", "word")
    )
    counted = tokens.groupBy("word").agg(F.count("*").alias("n"), first.alias("_first"))
    # Asking for the first places as well leaves the grouping as it is, so its exchange is reused.
    sums = counted.agg(F.struct(F.sum("n").alias("n"), F.max("_first").alias("last")).alias("sums"))
    total = sums.scalar()["n"]
    top = counted.orderBy(F.desc("n"), F.asc("_first")).limit(k)
    return top.select("word", "n", percentage(F.col("n"), total).alias("pct"))


def word_classes(
    df: DataFrame, text: str = "sentence", label: str = "label", first: int = 0, second: int = 1
) -> DataFrame:
    """Each word with flags for the two labels it appears in: one shuffle for all set questions."""
    return (
        _words(df, text, label)
        .groupBy("word")
        .agg(
            F.bool_or(F.col(label) == first).alias("in_first"),
            F.bool_or(F.col(label) == second).alias("in_second"),
        )
    )


def vocab_overlap(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Number of words found only under the first label, only under the second, and under both."""
    first, second = F.col("in_first"), F.col("in_second")
    return word_classes(df, text, label).agg(
        F.count_if(first & ~second).alias("only_first"),
        F.count_if(second & ~first).alias("only_second"),
        F.count_if(first & second).alias("shared"),
    )


def vocab_except(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Words of the first label that the second does not use."""
    return word_classes(df, text, label).where("in_first and not in_second").select("word")


def vocab_intersect(df: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """Words used under both labels."""
    return word_classes(df, text, label).where("in_first and in_second").select("word")
