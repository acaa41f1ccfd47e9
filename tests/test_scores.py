import math

import pytest
from pyspark.sql import functions as F

from lexgrain.functions import scores
from lexgrain.functions.logs import extract_accuracy
from lexgrain.operators import compare, ensemble, metrics


def test_softmax_and_argmax(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(0, [1.0, 3.0]), (1, [2.0, 2.0]), (2, [nan, 1.0]), (3, [1000.0, -1000.0]), (4, [0.0, 1.0, 5.0])],
        "id int, l array<double>",
    )
    rows = df.select(
        scores.softmax(F.col("l")).alias("p"), scores.argmax(F.col("l")).alias("a"),
        scores.positive_probability(F.col("l")[0], F.col("l")[1]).alias("p1"),
        scores.binary_argmax(F.col("l")[0], F.col("l")[1]).alias("b"),
    ).collect()
    assert [r["a"] for r in rows] == [1, 0, 0, 0, 2]
    assert [r["b"] for r in rows[:4]] == [1, 0, 0, 0]
    assert rows[0]["p"][1] == pytest.approx(1 / (1 + math.exp(-2))) == rows[0]["p1"]
    assert rows[3]["p"] == [1.0, 0.0] and rows[3]["p1"] == 0.0
    assert sum(rows[4]["p"]) == pytest.approx(1.0)


def test_mean_probability_and_mean_logit_differ(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 1.0, 0.0)], "id int, fold int, l0 double, l1 double")
    prob = ensemble.mean_probability(df).first()["pred_prob"]
    row = ensemble.mean_logit(df).first()
    assert prob == pytest.approx((1 / (1 + math.exp(-4)) + 1 / (1 + math.exp(1))) / 2)
    assert row["pred_prob"] == pytest.approx(1 / (1 + math.exp(-1.5))) and row["label"] == 1


SCHEMA = "id long, label int, pred_prob double"


def test_alignment(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2), (3, 1, 0.3)], SCHEMA)
    shuffled = spark.createDataFrame([(3, 1, 0.0), (1, 0, 0.0), (2, 1, 0.0)], SCHEMA)
    ensemble.require_aligned(a, shuffled)
    for other, problem in [
        ([(1, 0, 0.0), (2, 1, 0.0)], "missing_in_b"),
        ([(1, 0, 0.0), (2, 1, 0.0), (3, 1, 0.0), (4, 1, 0.0)], "missing_in_a"),
        ([(1, 0, 0.0), (2, 0, 0.0), (3, 1, 0.0)], "label_mismatch"),
        ([(1, 0, 0.0), (2, None, 0.0), (3, 1, 0.0)], "label_mismatch"),
        ([(1, 0, 0.0), (2, 1, 0.0), (3, 1, 0.0), (3, 1, 0.0)], "count_mismatch"),
    ]:
        with pytest.raises(ValueError, match=problem):
            ensemble.require_aligned(a, spark.createDataFrame(other, SCHEMA))


def test_oof_assembly_fills_missing_with_zero(spark):
    samples = spark.createDataFrame([(1, 0), (2, 1)], "id long, label int")
    parts = spark.createDataFrame([(2, 0.75)], "id long, pred_prob double")
    rows = ensemble.assemble_oof(samples, parts).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0.0), (2, 1, 0.75)]


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label int, target int")


def test_metrics_golden(spark):
    df = predictions(spark, [(1, 1), (1, 1), (1, 0), (0, 1), (0, 0)])
    row = metrics.accuracy_f1(df).first()
    assert (row["n"], row["accuracy"], row["f1"]) == (5, 0.6, pytest.approx(2 / 3))
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["0"]["precision"] == 0.5 and report["0"]["support"] == 2
    assert report["1"]["recall"] == pytest.approx(2 / 3)
    assert report["accuracy"]["f1"] == 0.6 and report["accuracy"]["support"] == 5
    assert report["macro avg"]["precision"] == pytest.approx((0.5 + 2 / 3) / 2)
    assert report["weighted avg"]["precision"] == pytest.approx((0.5 * 2 + 2 / 3 * 3) / 5)


def test_metrics_without_positives_and_with_unseen_class(spark):
    row = metrics.accuracy_f1(predictions(spark, [(0, 0)])).first()
    assert (row["accuracy"], row["f1"]) == (1.0, 0.0)
    report = {r["class"]: r for r in metrics.classification_report(predictions(spark, [(0, 2)])).collect()}
    assert report["2"]["precision"] == 0.0 and report["2"]["support"] == 0
    assert report["0"]["f1"] == 0.0


def test_mean_fold_f1_is_unweighted(spark):
    df = spark.createDataFrame(
        [(0, 1, 1), (1, 1, 0), (1, 1, 0), (1, 0, 0)], "fold int, label int, target int"
    )
    assert metrics.mean_fold_f1(df).first()["mean_f1"] == 0.5


def test_smoothed_cross_entropy(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1), ([2.0, 0.0], 1)], "logits array<double>, label int")

    def loss(l, y):
        z = math.log(sum(map(math.exp, l)))
        logp = [x - z for x in l]
        return -0.9 * logp[y] - 0.1 * sum(logp) / 2

    total = loss([0.0, 1.0], 1) + loss([2.0, 0.0], 1)
    assert metrics.smoothed_cross_entropy(df).first()["loss"] == pytest.approx(total / 2)
    counted = metrics.smoothed_cross_entropy(df, item_count=8).first()
    assert counted["loss"] == pytest.approx(total / 8)


def test_agreement_counts_repeated_ids_as_a_join_does(spark):
    rows = [(1, "a", 0, 1)] * 300 + [(1, "b", 1, 1)] * 200 + [(1, "b", 1, 0)] * 100 + [(2, "a", 0, 0)]
    df = spark.createDataFrame(rows, "id long, model string, model_ord int, target int")
    row = compare.pairwise_agreement(df).first()
    assert (row["agree"], row["total"]) == (300 * 200, 300 * 300)
    joined = compare.prediction_join(
        df.where("model = 'a'").select("id", "target"), df.where("model = 'b'").select("id", "target")
    )
    assert joined.count() == row["total"] and joined.columns == ["id", "target_1", "target_2"]


RUNS = [
    ("rf", 0, True, 1.0, 0.8), ("xgb", 1, True, 2.0, 0.8), ("bad", 2, False, 3.0, 0.9),
    ("zero", 3, True, 4.0, 0.0), ("none", 4, True, 5.0, None),
]


def test_runs(spark):
    runs = spark.createDataFrame(RUNS, "name string, run_ord int, success boolean, time double, accuracy double")
    assert [r["name"] for r in compare.rank_runs(runs, by=()).collect()] == ["rf"]
    ranked = compare.rank_runs(runs, by=(), top=None).orderBy("rank").collect()
    assert [r["name"] for r in ranked] == ["rf", "xgb"]
    summary = {r["name"]: r for r in compare.run_summary(runs).collect()}
    assert summary["bad"]["status"] == "Failed" and summary["bad"]["time"] is None
    assert summary["zero"]["accuracy"] is None and summary["rf"]["accuracy"] == 0.8


def test_log_scraping(spark):
    lines = [
        ("a", 1, "Validation Accuracy:     0.8125"), ("a", 2, "Validation Accuracy: 0.1"),
        ("b", 1, "Validation Accuracy: n/a"), ("c", 5, "xx Validation Accuracy:0.5 yy"),
    ]
    df = spark.createDataFrame(lines, "run_id string, seq int, line string")
    found = {r["run_id"]: r["accuracy"] for r in compare.log_accuracy(df).collect()}
    assert found == {"a": 0.8125, "b": None, "c": 0.5}
    text = spark.createDataFrame([("Validation Accuracy:\n 0.25\nValidation Accuracy: 0.75",)], "t string")
    assert text.select(extract_accuracy(F.col("t"))).first()[0] == 0.25


def test_natural_order(spark):
    names = [("fold10",), ("fold2",), ("final",), ("fold1",), ("fold1",)]
    ordered = compare.natural_order(spark.createDataFrame(names, "name string")).collect()
    assert [r["name"] for r in ordered] == ["fold1", "fold2", "fold10", "final"]


def test_alignment_compares_labels_as_multisets(spark):
    schema = "id long, label int"
    a = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1), (3, None)], schema)
    b = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (3, None)], schema)
    report = ensemble.alignment_report(a, b).first()
    assert (report["label_mismatch"], report["count_mismatch"], report["n_ids"]) == (1, 0, 3)
    assert ensemble.alignment_report(a, a).first()["label_mismatch"] == 0


def test_softmax_of_ten_classes(spark):
    logits = [0.5 * i - 700.0 for i in range(10)]
    row = spark.createDataFrame([(logits,)], "v array<double>").select(
        scores.softmax(F.col("v")).alias("p"), scores.log_softmax(F.col("v")).alias("l")
    ).first()
    exps = [math.exp(x - max(logits)) for x in logits]
    assert row["p"] == pytest.approx([e / sum(exps) for e in exps])
    assert row["l"] == pytest.approx([math.log(e / sum(exps)) for e in exps])


def test_agreement_takes_two_shuffles_after_its_source(spark, tables):
    from lexgrain.operators import compare

    rows = spark.createDataFrame([(1, "a", 0, 1)], "id long, model string, model_ord int, target int")
    plan = compare.pairwise_agreement(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # one of them counts equal votes map-side
    assert "Join" not in plan
