"""Classification metrics as grouped aggregates.

All metrics reduce to confusion counts, which are combined map-side: what is shuffled is a few
rows per task, whatever the balance of classes or models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.functions.scores import log_softmax, safe_ratio


def f1_column(label: Column, prediction: Column, positive: int = 1) -> Column:
    """Aggregate expression for binary F1; 0.0 when there is no positive at all."""
    tp = F.count_if((label == positive) & (prediction == positive))
    wrong = F.count_if((label == positive) != (prediction == positive))
    return safe_ratio(2.0 * tp, 2 * tp + wrong)


def accuracy_column(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def accuracy_f1(
    df: DataFrame, label: str = "label", prediction: str = "target", by: tuple[str, ...] = ()
) -> DataFrame:
    """``(by..., n, accuracy, f1)``."""
    y, p = F.col(label), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        accuracy_column(y, p).alias("accuracy"),
        f1_column(y, p).alias("f1"),
    )


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "target", by: tuple[str, ...] = ()
) -> DataFrame:
    return df.groupBy(*by, label, prediction).agg(F.count("*").alias("n"))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "target", by: tuple[str, ...] = ()
) -> DataFrame:
    """``(by..., class, precision, recall, f1, support)``.

    One row per class seen as label or prediction, then ``accuracy`` (its value stands in all
    three metric columns), ``macro avg`` and ``weighted avg``.  Empty denominators give 0.0.
    """
    n = F.col("n")
    as_label = F.struct(
        F.col(label).cast("string").alias("class"),
        n.alias("support"),
        F.lit(0).cast("bigint").alias("predicted"),
        F.when(F.col(label) == F.col(prediction), n).otherwise(0).alias("hits"),
    )
    as_prediction = F.struct(
        F.col(prediction).cast("string").alias("class"),
        F.lit(0).cast("bigint").alias("support"),
        n.alias("predicted"),
        F.lit(0).cast("bigint").alias("hits"),
    )
    classes = (
        confusion_counts(df, label, prediction, by)
        .select(*by, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*by, "class")
        .agg(
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
            F.sum("hits").alias("hits"),
        )
        .withColumn("precision", safe_ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", safe_ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1",
            safe_ratio(
                2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )
    metrics = ("precision", "recall", "f1")
    support = F.sum("support").alias("support")
    share = F.sum("hits") / F.sum("support")
    averages = classes.groupBy(*by).agg(
        F.struct(F.lit("accuracy").alias("class"), *[share.alias(m) for m in metrics], support)
        .alias("accuracy"),
        F.struct(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in metrics], support)
        .alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics],
            support,
        ).alias("weighted"),
    )
    summary = averages.select(*by, F.inline(F.array("accuracy", "macro", "weighted")))
    return classes.select(*by, "class", *metrics, "support").unionByName(summary)


def mean_fold_f1(
    df: DataFrame, label: str = "label", prediction: str = "target", fold: str = "fold"
) -> DataFrame:
    """Unweighted mean of the per-fold F1."""
    per_fold = accuracy_f1(df, label, prediction, (fold,))
    return per_fold.agg(F.count("*").alias("n_folds"), F.avg("f1").alias("mean_f1"))


def smoothed_cross_entropy(
    df: DataFrame,
    logits: str = "logits",
    label: str = "label",
    epsilon: float = 0.1,
    by: tuple[str, ...] = (),
    item_count: int | None = None,
) -> DataFrame:
    """Label-smoothed cross-entropy; the sum is divided by the rows or by ``item_count``."""
    logp = df.withColumn("_logp", log_softmax(F.col(logits)))
    uniform = F.aggregate("_logp", F.lit(0.0), lambda acc, x: acc + x) / F.size("_logp")
    hit = F.get("_logp", F.col(label).cast("int"))
    loss = -((1.0 - epsilon) * hit) - epsilon * uniform
    divisor = F.count("*") if item_count is None else F.lit(item_count)
    return logp.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(loss) / divisor).alias("loss"))
