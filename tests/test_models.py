import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from lexgrain.operators import ensemble, models, splits
from lexgrain.plans import relations as rel
from lexgrain.plans import workflows


@pytest.fixture(scope="module")
def toy(spark):
    """Label 1 talks about cats, label 0 about dogs."""
    return spark.range(120).select(
        "id",
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("the cat purrs "), F.col("id")))
        .otherwise(F.concat(F.lit("The DOG barks loud , loud "), F.col("id")))
        .alias("sentence"),
        (F.col("id") % 2).cast("int").alias("label"),
    )


def test_classifier_learns_and_predicts(spark, toy):
    test = spark.createDataFrame([(1, "a cat purrs"), (2, "the dog barks loud"), (3, None)], "id long, sentence string")
    fitted, predicted = workflows.train_and_predict(toy, test, estimator=models.forest(trees=5))
    assert fitted.metrics.first()["accuracy"] == 1.0 and fitted.metrics.first()["n"] == 24
    assert {r["class"] for r in fitted.report.collect()} >= {"0", "1", "macro avg"}
    assert {r["id"]: r["target"] for r in predicted.collect()} == {1: 1, 2: 0, 3: None}
    assert fitted.predict(test, nulls="drop").count() == 2
    with pytest.raises(Exception, match="null in sentence"):
        fitted.predict(test, nulls="reject").collect()


@pytest.mark.parametrize("options", [
    {"cleaning": False}, {"statistics": False}, {"fit_scope": "train"}, {"max_features": 3},
])
def test_optional_stages(toy, options):
    fitted = models.fit_text_classifier(toy, estimator=models.forest(trees=3), **options)
    assert fitted.metrics.first()["n"] == 24
    assert (fitted.featurizer.scaler is None) == (options.get("statistics") is False)


def test_bad_options(toy):
    with pytest.raises(ValueError):
        models.fit_text_classifier(toy, fit_scope="some")
    with pytest.raises(ValueError):
        models.fit_text_classifier(toy, nulls="keep")


def newton(x, y, steps=60):
    """Logistic regression with unit-strength L2 on the weights, intercept free."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + penalty @ w
        hessian = (design.T * (p * (1 - p))) @ design + penalty
        w -= np.linalg.solve(hessian, gradient)
    return w


def test_stacker_matches_an_independent_solver(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(3 * x[:, 0] - x[:, 1])))).astype(int)
    rows = [(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x, strict=True))]
    stacked = spark.createDataFrame(rows, "id long, label int, prob_a double, prob_b double")
    fitted = models.Stacker.fit(stacked)
    assert (fitted.coef_a, fitted.coef_b, fitted.intercept) == pytest.approx(tuple(newton(x, y)), abs=1e-5)
    summary = fitted.summary(stacked).first()
    assert summary["n"] == 300 and 0 <= summary["f1"] <= 1


def test_stacking_workflow_rejects_misaligned_sets(spark, tables):
    a, b = rel.oof(spark, tables, 0), rel.oof(spark, tables, 1)
    scored = rel.logits(spark, tables)
    _, predicted = workflows.stack_and_predict(a, b, scored.where("fold < 3"), scored.where("fold >= 3"))
    assert predicted.count() == a.count()
    with pytest.raises(ValueError, match="missing_in_b"):
        workflows.stack_and_predict(a, b.where("id > 0"), scored, scored)


def test_out_of_fold_covers_every_row_once(toy):
    folds = splits.stratified_kfold(toy.select("id", "label"), k=3)
    folded = models.with_hashed_counts(toy, features=256).join(folds.select("id", "fold"), "id")
    rows = models.out_of_fold(folded, k=3, parallelism=3).collect()
    assert sorted(r["id"] for r in rows) == list(range(120))
    assert all((r["pred_prob"] > 0.5) == (r["label"] == 1) and 0 <= r["pred_prob"] <= 1 for r in rows)


def test_out_of_fold_does_not_see_the_held_out_rows(spark):
    """Two rows per fold whose labels contradict the other fold: the prediction must be wrong."""
    df = spark.createDataFrame(
        [(i, int(i % 2), i // 4, float((i % 2) ^ (i // 4))) for i in range(8)], "id long, label int, fold int, x double"
    )
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    estimator = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression()])
    rows = models.out_of_fold(df, k=2, estimator=estimator).collect()
    assert all((r["pred_prob"] > 0.5) != (r["label"] == 1) for r in rows)


def test_batch_scoring(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(70)], "id long, v array<float>")
    score = models.batch_scorer(models.linear_scorer([[1.0, 0.0], [2.0, -1.0]]), width=2)
    rows = df.select("id", score(F.col("v")).alias("s")).collect()
    assert all(r["s"] == [r["id"] + 2.0, -1.0] for r in rows)


def test_ensemble_and_comparison_workflows(spark, tables):
    labels = workflows.ensemble_predict(rel.logits(spark, tables))
    assert labels.columns == ["id", "label"] and labels.count() > 0
    report = workflows.compare_models(rel.preds(spark, tables), rel.runs(spark, tables))
    assert report["agreement"].count() == 3 and report["best"].count() > 0
    parts = workflows.profile_corpus(rel.sent(spark, tables), rel.unlabelled(spark, tables))
    assert all(part.count() >= 0 for part in parts.values()) and "test_lengths" in parts


def test_union_keeps_duplicates(spark):
    one = spark.createDataFrame([(1, 1)], "id long, target int")
    assert ensemble.union_all([one, one, one]).count() == 3


def test_saved_classifier_and_stacker_predict_alike(spark, toy, tmp_path):
    fitted = models.fit_text_classifier(toy, estimator=models.forest(trees=3), evaluate=False, max_rows=100)
    fitted.save(str(tmp_path / "classifier"))
    loaded = models.TextClassifier.load(spark, str(tmp_path / "classifier"))
    test = toy.select("id", "sentence")
    assert sorted(loaded.predict(test).collect()) == sorted(fitted.predict(test).collect())
    stacked = toy.select("label", (F.col("id") / 120).alias("prob_a"), (F.col("label") * 0.8).alias("prob_b"))
    stacker = models.Stacker.fit(stacked)
    stacker.save(str(tmp_path / "stacker"))
    again = models.Stacker.load(spark, str(tmp_path / "stacker"))
    assert (again.coef_a, again.coef_b, again.intercept) == (stacker.coef_a, stacker.coef_b, stacker.intercept)
    assert sorted(again.predict(stacked).collect()) == sorted(stacker.predict(stacked).collect())


def test_fold_models_score_test_rows_and_null_texts(spark, toy):
    rows = toy.union(spark.createDataFrame([(500, None, 1)], "id long, sentence string, label int"))
    folds = splits.stratified_kfold(rows.select("id", "label"), k=3)
    folded = models.with_hashed_counts(rows, features=256).join(folds.select("id", "fold"), "id")
    test = models.with_hashed_counts(toy.select("id", "sentence"), features=256)
    oof, logits = workflows.cross_validated_scores(folded, test, k=3)
    assert sorted(r["id"] for r in oof.collect()) == [*range(120), 500]
    assert logits.count() == 360
    labels = {r["id"]: r["label"] for r in workflows.ensemble_predict(logits).collect()}
    assert labels == {i: i % 2 for i in range(120)}
    _, stacked = workflows.stack_and_predict(
        oof.where("id < 500"), oof.where("id < 500"), logits, logits
    )
    assert stacked.count() == 120


def test_only_successful_runs_are_compared(spark, tables):
    runs = rel.runs(spark, tables).withColumn("success", F.col("name") != "m1")
    report = workflows.compare_models(rel.preds(spark, tables), runs)
    assert {r["model"] for r in report["distribution"].collect()} == {"m0", "m2"}
    assert report["agreement"].count() == 1


@pytest.mark.parametrize("rows_per_task, parts", [(1 << 16, 8), (10, 12)])
def test_fits_see_as_many_parts_as_cores(spark, toy, monkeypatch, rows_per_task, parts):
    """A task of a forest sends all node statistics, so parts must not grow with the files."""

    class Spy:
        def fit(self, vectors):
            self.parts, self.ids = vectors.rdd.getNumPartitions(), sorted(r["id"] for r in vectors.collect())

    monkeypatch.setattr(models, "ROWS_PER_TASK", rows_per_task)
    spy = Spy()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # what opening one small file counts
    try:
        models.fit_text_classifier(toy.repartition(40), estimator=spy, evaluate=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert spark.sparkContext.defaultParallelism == 8 and spy.parts == parts
    assert spy.ids == list(range(120))
