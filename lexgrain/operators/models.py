"""Training and scoring with Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from lexgrain.functions import text as tx
from lexgrain.operators.ensemble import union_all
from lexgrain.operators.features import FEATURES, Scaler, with_cleaned, with_text_features
from lexgrain.operators.forest import ForestClassifier
from lexgrain.operators.metrics import accuracy_f1, classification_report
from lexgrain.operators.splits import fold_train, fold_validation, stratified_holdout
from lexgrain.operators.tfidf import TfidfModel
from lexgrain.session import discard, ensure_checkpoint_folder, kept_table, new_scratch_path

DISK = StorageLevel.MEMORY_AND_DISK
#: Rows of a fit that one task may hold before there are more tasks than cores; a row that Spark ML's
#: forest has binned takes about 20 KB with 5,000 features.
ROWS_PER_TASK = 1 << 16


def forest(trees: int = 100, seed: int = 42) -> ForestClassifier:
    """Random forest whose tasks grow whole trees, so that no statistics of nodes are sent."""
    return ForestClassifier(trees=trees, max_depth=20, least=2, seed=seed)


def reject_or_drop_nulls(df: DataFrame, text: str, nulls: str) -> DataFrame:
    """Apply the ``nulls`` option ("drop" or "reject") before a fit."""
    if nulls == "drop":
        return df.where(F.col(text).isNotNull())
    if nulls == "reject":
        checked = F.coalesce(F.col(text), F.raise_error(F.lit(f"null in {text}")))
        return df.withColumn(text, checked)
    raise ValueError("nulls must be 'drop' or 'reject'")


@dataclass(frozen=True)
class TextFeaturizer:
    """Fitted text-to-vector step: TF-IDF first, then the scaled statistical features."""

    tfidf: TfidfModel
    scaler: Scaler | None
    cleaning: bool

    @classmethod
    def fit(
        cls, df: DataFrame, max_features: int = 5000, cleaning: bool = True, statistics: bool = True
    ) -> TextFeaturizer:
        text = with_cleaned(df.select("sentence")) if cleaning else df.select("sentence")
        scaler = Scaler.fit(with_text_features(text).select(*FEATURES)) if statistics else None
        # Cleaning only moves spaces next to other separators, so word tokens do not depend on it.
        tfidf = TfidfModel.fit(df.select("sentence"), max_features=max_features)
        return cls(tfidf, scaler, cleaning)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``; one pass over the rows, without a shuffle.

        Terms are taken from the stored text: cleaning does not change them, and the null test
        then stays a plain filter of the scan.
        """
        rows = self.tfidf.vectors(df)
        inputs = ["tfidf"]
        if self.scaler is not None:
            rows = with_cleaned(rows) if self.cleaning else rows
            rows = self.scaler.transform(with_text_features(rows))
            inputs += FEATURES
        return (
            VectorAssembler(inputCols=inputs, outputCol="features")
            .transform(rows)
            .drop(*inputs, *FEATURES)
        )


@dataclass(frozen=True)
class TextClassifier:
    """Featurizer and classifier fitted on all rows, with the hold-out evaluation of the same setup."""

    featurizer: TextFeaturizer
    model: Model
    metrics: DataFrame | None
    report: DataFrame | None

    def predict(self, df: DataFrame, keep: tuple[str, ...] = ("id",), nulls: str = "keep"):
        """``(keep..., target)``, one row per row of ``df``; a null ``sentence`` has a null target.

        ``nulls="drop"`` and ``"reject"`` leave such rows out or raise.
        """
        rows = df.select(*keep, "sentence")
        if nulls != "keep":
            rows = reject_or_drop_nulls(rows, "sentence", nulls)
        known = F.col("sentence").isNotNull()
        rows = rows.withColumn("_known", known).withColumn("sentence", F.coalesce("sentence", F.lit("")))
        scored = self.model.transform(self.featurizer.transform(rows))
        target = F.when(F.col("_known"), F.col("prediction").cast("int"))
        return scored.select(*keep, target.alias("target"))

    def save(self, path: str) -> None:
        """Write featurizer and model below ``path``, which every executor must reach."""
        self.model.write().save(f"{path}/model")
        scaler = self.featurizer.scaler
        settings = {
            "terms": self.featurizer.tfidf.terms,
            "idf": self.featurizer.tfidf.idf,
            "means": scaler.means if scaler else None,
            "stds": scaler.stds if scaler else None,
            "cleaning": self.featurizer.cleaning,
        }
        _write_settings(self.model, settings, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextClassifier:
        """A saved classifier; evaluation tables are not part of it."""
        s = _read_settings(spark, path)
        scaler = Scaler(s["means"], s["stds"]) if s["means"] is not None else None
        featurizer = TextFeaturizer(TfidfModel(s["terms"], s["idf"]), scaler, s["cleaning"])
        return cls(featurizer, _load_model(spark, path), None, None)


def _write_settings(model: Model, settings: dict, path: str) -> None:
    """Settings as one row of Parquet beside the model."""
    spark = SparkSession.getActiveSession()
    row = spark.range(1, numPartitions=1).select(F.lit(json.dumps(settings)).alias("settings"))
    row.write.parquet(f"{path}/settings")


def _read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])


def _load_model(spark: SparkSession, path: str) -> Model:
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)


def _evaluate(estimator: Estimator, vectors: DataFrame) -> DataFrame:
    """``(id, label, target)`` of the rows with ``is_test`` for a fit on the others."""
    model = estimator.fit(vectors.where(~F.col("is_test")))
    scored = model.transform(vectors.where("is_test"))
    return scored.select("id", "label", F.col("prediction").cast("int").alias("target"))


def fit_text_classifier(
    train: DataFrame,
    estimator: Estimator | None = None,
    max_features: int = 5000,
    cleaning: bool = True,
    statistics: bool = True,
    fit_scope: str = "all",
    test_size: float = 0.2,
    seed: int = 42,
    nulls: str = "drop",
    evaluate: bool = True,
    max_rows: int | None = None,
) -> TextClassifier:
    """Fit on 80 %, evaluate on the stratified rest, then fit again on all rows.

    With ``fit_scope="all"`` vocabulary and scaler see the evaluation rows as well; "train" fits
    them for the evaluation on the training part alone.  ``evaluate=False`` only fits on all rows.
    ``train`` needs ``id, sentence, label``.  ``max_rows`` bounds the rows that are fitted, taken in
    the order of a hash of the id.

    The rows are written to the shared folder once, with their part of the hold-out, so that the
    source is not read and joined again by every pass of a fit.  In every pass of a Spark ML forest
    each task sends the statistics of all growing nodes, however few rows it has, so the vectors lie in
    as many parts as there are cores and not in as many as the files have.
    """
    if fit_scope not in ("all", "train"):
        raise ValueError("fit_scope must be 'all' or 'train'")
    spark = train.sparkSession
    ensure_checkpoint_folder(spark)  # cached node ids cut their lineage there
    estimator = estimator or forest(seed=seed)
    rows = reject_or_drop_nulls(train.select("id", "sentence", "label"), "sentence", nulls)
    if max_rows is not None:
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_rows)
    if evaluate:
        parts = stratified_holdout(rows.select("id", "label"), "id", "label", test_size, seed)
        rows = rows.join(parts.select("id", "is_test"), "id")
    path = new_scratch_path(spark, "train")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    options = {"max_features": max_features, "cleaning": cleaning, "statistics": statistics}
    featurizer = TextFeaturizer.fit(rows, **options)
    tasks = max(spark.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK)
    vectors = featurizer.transform(rows).drop("sentence").coalesce(tasks).persist(DISK)
    metrics = report = None
    try:
        if evaluate:
            held_out = vectors
            if fit_scope == "train":
                scoped = TextFeaturizer.fit(rows.where(~F.col("is_test")), **options)
                held_out = scoped.transform(rows).drop("sentence").coalesce(tasks)
            metrics, report = _evaluation_tables(_evaluate(estimator, held_out))
        model = estimator.fit(vectors)
    finally:
        vectors.unpersist()
        discard(spark, path)
    return TextClassifier(featurizer, model, metrics, report)


def _evaluation_tables(held_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics and report as values (a few rows each), so that scoring is not repeated."""
    held_out = held_out.persist(DISK)
    try:
        spark = held_out.sparkSession
        return tuple(
            spark.createDataFrame(df.collect(), df.schema)
            for df in (accuracy_f1(held_out), classification_report(held_out))
        )
    finally:
        held_out.unpersist()


@dataclass(frozen=True)
class Stacker:
    """Logistic meta-model over two probability columns."""

    model: Model
    coef_a: float
    coef_b: float
    intercept: float

    @staticmethod
    def _vector(stacked: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=["prob_a", "prob_b"], outputCol="features").transform(
            stacked
        )

    @classmethod
    def fit(cls, stacked: DataFrame) -> Stacker:
        """Fit on ``(prob_a, prob_b, label)``.

        The penalty is one over the row count on raw features, which is the objective of a
        library solver with inverse strength C = 1.
        """
        rows = cls._vector(stacked.select("prob_a", "prob_b", "label")).persist(DISK)
        try:
            estimator = LogisticRegression(
                labelCol="label",
                regParam=1.0 / rows.count(),
                elasticNetParam=0.0,
                standardization=False,
                maxIter=500,
                tol=1e-10,
            )
            model = estimator.fit(rows)
        finally:
            rows.unpersist()
        return cls(model, *(float(c) for c in model.coefficients), float(model.intercept))

    def predict(self, stacked: DataFrame) -> DataFrame:
        """Add ``target``."""
        scored = self.model.transform(self._vector(stacked))
        return scored.select(*stacked.columns, F.col("prediction").cast("int").alias("target"))

    def save(self, path: str) -> None:
        """Write the meta-model below ``path``."""
        self.model.write().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Stacker:
        model = _load_model(spark, path)
        return cls(model, *(float(c) for c in model.coefficients), float(model.intercept))

    def summary(self, stacked: DataFrame) -> DataFrame:
        """Coefficients, intercept and in-sample F1 as one row."""
        return accuracy_f1(self.predict(stacked)).select(
            F.lit(self.coef_a).alias("coef_a"),
            F.lit(self.coef_b).alias("coef_b"),
            F.lit(self.intercept).alias("intercept"),
            "n",
            "f1",
        )


def with_hashed_counts(df: DataFrame, text: str = "sentence", features: int = 1 << 16) -> DataFrame:
    """Replace ``text`` by ``tf``, a sparse vector of hashed word counts; nothing is fitted.

    A null text has no words and keeps its row, so that every id gets a prediction.
    """
    tokens = df.withColumn("_words", tx.word_tokens(F.coalesce(text, F.lit(""))))
    hashing = HashingTF(inputCol="_words", outputCol="tf", numFeatures=features)
    return hashing.transform(tokens).drop("_words", text)


def linear_text_model() -> Pipeline:
    """Inverse document frequency and logistic regression on ``tf``, fitted on the training rows."""
    return Pipeline(
        stages=[
            IDF(inputCol="tf", outputCol="features", minDocFreq=2),
            LogisticRegression(labelCol="label", regParam=0.1, maxIter=25),
        ]
    )


def fit_folds(
    folded: DataFrame, k: int = 5, estimator: Estimator | None = None, parallelism: int = 1
) -> list[Model]:
    """One model per fold, fitted on the rows of the other folds.

    ``folded`` holds what the estimator reads plus ``fold``; it should carry features rather than
    text, since it is read by every fit.  ``parallelism`` fits run at a time: raise it when one
    fit leaves executors idle.
    """
    estimator = estimator or linear_text_model()
    train = inheritable_thread_target(folded.sparkSession)(
        lambda held_out: estimator.fit(fold_train(folded, held_out))
    )
    with ThreadPool(min(parallelism, k)) as pool:
        return pool.map(train, range(k))


def out_of_fold(
    folded: DataFrame,
    k: int = 5,
    estimator: Estimator | None = None,
    keep: tuple[str, ...] = ("id", "label", "fold"),
    parallelism: int = 1,
    models: list[Model] | None = None,
) -> DataFrame:
    """Predict every fold with the model that did not see it: ``(keep..., pred_prob)``.

    ``models`` are those of ``fit_folds``; without them ``folded`` is written to the shared folder
    once and fitted here.
    """
    if models is None:
        folded = kept_table(folded, "folded")
        models = fit_folds(folded, k, estimator, parallelism)
    return union_all(
        [
            model.transform(fold_validation(folded, held_out)).select(
                *keep, F.get(vector_to_array("probability"), F.lit(1)).alias("pred_prob")
            )
            for held_out, model in enumerate(models)
        ]
    )


def score_folds(
    models: list[Model], test: DataFrame, name: str = "a", keep: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Logits of ``test`` under every fold's model: ``(keep..., model, fold, l0, l1)``."""
    raw = vector_to_array("rawPrediction")
    return union_all(
        [
            model.transform(test).select(
                *keep,
                F.lit(name).alias("model"),
                F.lit(fold).alias("fold"),
                F.get(raw, F.lit(0)).alias("l0"),
                F.get(raw, F.lit(1)).alias("l1"),
            )
            for fold, model in enumerate(models)
        ]
    )


def batch_scorer(
    make_predict: Callable, width: int, batch_size: int = 32
) -> Callable[[Column], Column]:
    """Column function that scores ``array`` inputs of ``width`` in batches.

    ``make_predict`` is called once per Python worker and returns a function from a numpy batch to
    a numpy array with one row of scores per input.
    """
    return predict_batch_udf(
        make_predict,
        return_type=ArrayType(DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )


def linear_scorer(weights: list[list[float]]) -> Callable:
    """Factory for :func:`batch_scorer`: logits of a fixed linear model (inputs x classes)."""

    def make_predict():
        matrix = np.asarray(weights, dtype=np.float64)

        def predict(batch: np.ndarray) -> np.ndarray:
            return batch.astype(np.float64) @ matrix

        return predict

    return make_predict
