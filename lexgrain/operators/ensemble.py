"""Combining fold and model outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.functions.scores import binary_argmax, positive_probability


def mean_probability(
    logits: DataFrame, by: tuple[str, ...] = ("id",), l0: str = "l0", l1: str = "l1"
) -> DataFrame:
    """Softmax per fold, then the mean over folds: ``(by..., pred_prob)``."""
    p1 = positive_probability(F.col(l0), F.col(l1))
    return logits.groupBy(*by).agg(F.avg(p1).alias("pred_prob"))


def mean_logit(
    logits: DataFrame, by: tuple[str, ...] = ("id",), l0: str = "l0", l1: str = "l1"
) -> DataFrame:
    """Mean logits over folds, then softmax and label: ``(by..., pred_prob, label)``."""
    means = logits.groupBy(*by).agg(F.avg(l0).alias("_m0"), F.avg(l1).alias("_m1"))
    return means.select(
        *by,
        positive_probability(F.col("_m0"), F.col("_m1")).alias("pred_prob"),
        binary_argmax(F.col("_m0"), F.col("_m1")).alias("label"),
    )


def alignment_report(a: DataFrame, b: DataFrame, id: str = "id", label: str = "label") -> DataFrame:
    """Count ids missing on either side, label differences and repeated ids, as one row.

    Labels are compared as multisets: equal ``(id, label)`` rows are counted on both sides and then
    folded to ids.  Both steps combine map-side, so a repeated id is folded before it travels, which
    a full outer join would multiply.
    """
    tagged = a.select(id, F.col(label).alias("_label"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    tagged = tagged.unionByName(
        b.select(id, F.col(label).alias("_label"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per_label = tagged.groupBy(id, "_label").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    per_id = per_label.groupBy(id).agg(
        F.sum("_a").alias("_n_a"),
        F.sum("_b").alias("_n_b"),
        F.bool_and(F.col("_a") == F.col("_b")).alias("_same"),
        F.bool_and((F.col("_a") > 0) == (F.col("_b") > 0)).alias("_same_labels"),
    )
    both = (F.col("_n_a") > 0) & (F.col("_n_b") > 0)
    # Where counts differ the multisets must differ; then only the sets of labels are compared.
    same = F.when(F.col("_n_a") == F.col("_n_b"), F.col("_same")).otherwise(F.col("_same_labels"))
    return per_id.agg(
        F.count_if(F.col("_n_a") == 0).alias("missing_in_a"),
        F.count_if(F.col("_n_b") == 0).alias("missing_in_b"),
        F.count_if(both & ~same).alias("label_mismatch"),
        F.count_if(both & (F.col("_n_a") != F.col("_n_b"))).alias("count_mismatch"),
        F.count("*").alias("n_ids"),
    )


def require_aligned(a: DataFrame, b: DataFrame, id: str = "id", label: str = "label") -> None:
    """Raise ``ValueError`` unless both sets hold the same ids with the same labels."""
    report = alignment_report(a, b, id, label).first().asDict()
    problems = {k: v for k, v in report.items() if k != "n_ids" and v}
    if problems:
        raise ValueError(f"prediction sets do not align: {problems}")


def stack_probabilities(a: DataFrame, b: DataFrame, id: str = "id", prob: str = "pred_prob"):
    """Inner join on id with the two probabilities as ``prob_a`` and ``prob_b``.

    Columns other than the probability come from ``a``.
    """
    right = b.select(id, F.col(prob).alias("prob_b"))
    return a.withColumnRenamed(prob, "prob_a").join(right, id)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda x, y: x.unionByName(y), parts)


def assemble_oof(
    samples: DataFrame, predictions: DataFrame, id: str = "id", prob: str = "pred_prob"
) -> DataFrame:
    """Attach held-out predictions to all samples; a sample without one gets 0.0."""
    return samples.join(predictions.select(id, prob), id, "left").withColumn(
        prob, F.coalesce(prob, F.lit(0.0))
    )
