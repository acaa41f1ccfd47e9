"""Comparing prediction sets and ranking runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions.logs import ACCURACY_PATTERN, extract_accuracy
from lexgrain.functions.scores import percentage


def prediction_distribution(
    df: DataFrame, model: str = "model", target: str = "target", classes: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """Rows and percentage of each class per model, zero for a class never predicted."""
    columns = [F.count("*").alias("n")]
    for c in classes:
        hits = F.count_if(F.col(target) == c)
        columns += [
            hits.alias(f"count_{c}"),
            percentage(hits, F.count("*")).alias(f"pct_{c}"),
        ]
    return df.groupBy(model).agg(*columns)


def prediction_join(a: DataFrame, b: DataFrame, id: str = "id") -> DataFrame:
    """Inner join on id; all other columns get the suffixes ``_1`` and ``_2``."""
    left = a.select(id, *[F.col(c).alias(f"{c}_1") for c in a.columns if c != id])
    right = b.select(id, *[F.col(c).alias(f"{c}_2") for c in b.columns if c != id])
    return left.join(right, id)


def pairwise_agreement(
    df: DataFrame,
    model: str = "model",
    order: str = "model_ord",
    id: str = "id",
    target: str = "target",
) -> DataFrame:
    """``(model_1, model_2, agree, total, pct)`` for every unordered pair of models, in one job.

    Equal predictions of an id are counted map-side and gathered by id, at most one entry per model
    and class; pairs of entries are made inside the row, and the products restore the number of
    matching row pairs.
    """
    votes = df.where(F.col(id).isNotNull()).groupBy(id, order, model, target).agg(F.count("*").alias("c"))
    entry = F.struct(
        F.col(order).alias("ord"), F.col(model).alias("model"), F.col(target).alias("t"), "c"
    )
    gathered = votes.groupBy(id).agg(F.sort_array(F.collect_list(entry)).alias("_votes"))
    pairs = F.flatten(
        F.transform(
            "_votes",
            lambda a: F.transform(
                F.filter("_votes", lambda b: a["ord"] < b["ord"]),
                lambda b: F.struct(
                    a["model"].alias("model_1"),
                    b["model"].alias("model_2"),
                    F.coalesce(a["t"] == b["t"], F.lit(False)).alias("same"),
                    (a["c"] * b["c"]).alias("matches"),
                ),
            ),
        )
    )
    return (
        gathered.select(F.inline(pairs))
        .groupBy("model_1", "model_2")
        .agg(
            F.sum(F.when(F.col("same"), F.col("matches")).otherwise(0)).alias("agree"),
            F.sum("matches").alias("total"),
        )
        .withColumn("pct", percentage(F.col("agree"), F.col("total")))
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Status text, time of successful runs, accuracy when it is known and not zero."""
    return runs.select(
        *[c for c in runs.columns if c not in ("success", "time", "accuracy")],
        F.when(F.col("success"), "Success").otherwise("Failed").alias("status"),
        F.when(F.col("success"), F.col("time")).alias("time"),
        F.nullif(F.col("accuracy"), F.lit(0.0)).alias("accuracy"),
    )


def rank_runs(
    runs: DataFrame,
    by: tuple[str, ...] = ("experiment",),
    order: str = "run_ord",
    top: int | None = 1,
) -> DataFrame:
    """Successful runs with a non-zero accuracy, best first; ties keep the run order.

    With ``top`` Spark drops all but the best rows of each group before the shuffle.
    """
    usable = runs.where("success and accuracy is not null and accuracy <> 0")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("accuracy"), F.asc(order)))
    ranked = usable.withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def log_accuracy(
    logs: DataFrame, run: str = "run_id", seq: str = "seq", line: str = "line"
) -> DataFrame:
    """First reported accuracy of each run; null for a run that reports none."""
    hit = F.col(line).rlike(ACCURACY_PATTERN)
    value = extract_accuracy(F.col(line))
    return logs.groupBy(run).agg(F.min_by(value, F.when(hit, F.col(seq))).alias("accuracy"))


def natural_order(names: DataFrame, name: str = "name", key: str = "sort_key") -> DataFrame:
    """Distinct names sorted by the number their digits spell, 999 without digits."""
    digits = F.regexp_replace(name, "[^0-9]", "")
    number = F.coalesce(digits.try_cast("bigint"), F.lit(999).cast("bigint"))
    counted = names.groupBy(name).agg(F.count("*").alias("n"))
    return counted.withColumn(key, number).orderBy(key, name)
