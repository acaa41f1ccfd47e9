"""Relations derived from the given tables for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions.scores import binary_argmax, positive_probability
from lexgrain.operators.metrics import accuracy_column

FOLDS = 5
#: A public vocabulary with word ends.
PIECES = "/opt/tokenizers/word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled sentences ``(id, sentence, label)``."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return (
        _documents(spark, folder)
        .join(labels, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.col("text").alias("sentence"),
            F.col("quality").alias("label"),
        )
    )


def labelled_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, label, lang)`` of the labelled sentences; never reads their text."""
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), "lang"
    )


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """``sent`` with the spacing faults that cleaning repairs."""
    spaced = F.replace("sentence", F.lit("."), F.lit(" ."))
    slashed = F.replace(spaced, F.lit(" the "), F.lit(" / "))
    return sent(spark, folder).withColumn("sentence", F.concat(F.lit('" '), slashed, F.lit(' "')))


def unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, sentence)`` of the documents without a label."""
    labels = table(spark, folder, "labels").select("doc_id")
    return (
        _documents(spark, folder)
        .join(labels, "doc_id", "left_anti")
        .select(F.col("doc_id").alias("id"), F.col("text").alias("sentence"))
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Two consecutive turns as one nested record.

    ``(conv_id, turn)`` is the key of the table, so a record holds at most two turns however long
    a conversation is.
    """
    turn = F.struct(
        "turn", "text", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("label")
    )
    return (
        table(spark, folder, "conversations")
        .groupBy("conv_id", F.expr("turn div 2").alias("pair_no"))
        .agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
        .select(
            "conv_id",
            "pair_no",
            F.col("_turns.text").alias("sentence_pair"),
            F.col("_turns.label").alias("label_pair"),
        )
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, fold, l0, l1, label)``: five two-class logit pairs per vector."""
    fold_logits = [
        F.struct(
            F.lit(f).alias("fold"),
            F.col("embedding")[2 * f].cast("double").alias("l0"),
            F.col("embedding")[2 * f + 1].cast("double").alias("l1"),
        )
        for f in range(FOLDS)
    ]
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 2).alias("label"),
        F.inline(F.array(*fold_logits)),
    )


def oof(spark: SparkSession, folder: str, fold: int) -> DataFrame:
    """Out-of-fold set ``(id, label, pred_prob)``; fold 0 stands for model A, fold 1 for B."""
    return (
        logits(spark, folder)
        .where(F.col("fold") == fold)
        .select("id", "label", positive_probability(F.col("l0"), F.col("l1")).alias("pred_prob"))
    )


def preds(spark: SparkSession, folder: str) -> DataFrame:
    """Three deterministic models: ``(model, model_ord, id, y, target, experiment)``."""
    y = F.col("label")
    targets = [
        (F.col("id") % 2).cast("int"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0),
        F.when(F.col("id") % 5 == 0, 1 - y).otherwise(y),
    ]
    models = [
        F.struct(
            F.lit(f"m{i}").alias("model"), F.lit(i).alias("model_ord"), target.alias("target")
        )
        for i, target in enumerate(targets)
    ]
    return labelled_ids(spark, folder).select(
        "id", y.alias("y"), F.col("lang").alias("experiment"), F.inline(F.array(*models))
    )


def one_model(predictions: DataFrame, model: str) -> DataFrame:
    return predictions.where(F.col("model") == model).select("id", "target")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run results per language; run m1 counts as failed on German."""
    by_run = (
        preds(spark, folder)
        .groupBy("experiment", F.col("model_ord").alias("run_ord"), F.col("model").alias("name"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("y") == F.col("target")).alias("n_correct"),
            accuracy_column(F.col("y"), F.col("target")).alias("accuracy"),
        )
    )
    success = ~((F.col("name") == "m1") & (F.col("experiment") == "de"))
    return by_run.select(
        "experiment",
        "run_ord",
        "name",
        success.alias("success"),
        (F.col("n") / F.lit(100.0)).alias("time"),
        F.when(success, F.col("accuracy")).alias("accuracy"),
        F.concat(F.lit("submission_"), F.col("name"), F.lit(".csv")).alias("output_file"),
        F.expr("(n_correct * 10000) div n").alias("basis_points"),
    )


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """Captured output of the runs as lines; failed runs report no metric."""
    bp = F.col("basis_points")
    four_digits = F.concat(
        F.expr("basis_points div 10000").cast("string"),
        F.lit("."),
        F.lpad((bp % 10000).cast("string"), 4, "0"),
    )
    metric = F.concat(F.rpad(F.lit("Validation Accuracy:"), 25, " "), F.lit(" "), four_digits)
    lines = [
        (1, F.concat(F.lit("Training "), F.col("name"))),
        (2, F.when(F.col("success"), metric).otherwise(F.lit("Traceback"))),
        (3, F.when(F.col("success"), F.lit("Validation Accuracy: 0.0001")).otherwise(F.lit(""))),
        (4, F.concat(F.lit("Output: "), F.col("output_file"))),
    ]
    entries = [F.struct(F.lit(seq).alias("seq"), line.alias("line")) for seq, line in lines]
    return runs(spark, folder).select(
        F.concat_ws("/", "experiment", "name").alias("run_id"), F.inline(F.array(*entries))
    )


def fold_names(spark: SparkSession, folder: str) -> DataFrame:
    """One fold folder name per labelled id."""
    i = F.col("id")
    return labelled_ids(spark, folder).select(
        F.when(i % 50 == 0, F.lit("final"))
        .otherwise(F.concat(F.lit("fold"), (i % 12).cast("string")))
        .alias("name")
    )


def fold_predictions(spark: SparkSession, folder: str, folded: DataFrame) -> DataFrame:
    """Score of each ``(id, label, fold)`` sample with logits for its fold."""
    scored = logits(spark, folder).select(
        "id",
        "fold",
        positive_probability(F.col("l0"), F.col("l1")).alias("pred_prob"),
        binary_argmax(F.col("l0"), F.col("l1")).alias("target"),
    )
    return folded.join(scored, ["id", "fold"])
