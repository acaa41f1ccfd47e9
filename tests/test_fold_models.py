import numpy as np
import pytest

from lexgrain.operators import models
from lexgrain.operators.ensemble import mean_logit
from lexgrain.operators.fold_models import FoldModels, WordFoldModels, stored_scorer, with_text_shape
from lexgrain.session import ship_package

FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows():
    pick = np.random.default_rng(3)
    x = pick.normal(size=(300, 3))
    label = (x @ [1.0, -2.0, 0.5] + pick.normal(size=300) > 0.3).astype(int)
    return [(i, int(label[i]), i % 4, *map(float, x[i])) for i in range(300)]


@pytest.fixture(scope="module")
def folded(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, fold int, a double, b double, c double").repartition(5)


def newton(x, y, penalty):
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([0.0, *[penalty] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def test_all_folds_equal_single_fits(folded, rows):
    fitted = FoldModels.fit(folded, FEATURES, k=4)
    x, y = np.array([r[3:] for r in rows]), np.array([r[1] for r in rows])
    fold = np.array([r[2] for r in rows])
    for m in range(4):
        assert np.allclose(fitted.weights[m], newton(x[fold != m], y[fold != m], 1.0), atol=1e-8)
    got = {r["id"]: r["pred_prob"] for r in fitted.out_of_fold(folded).collect()}
    margins = np.hstack([np.ones((300, 1)), x]) @ np.array(fitted.weights).T
    expected = 1 / (1 + np.exp(-margins[np.arange(300), fold]))
    assert np.allclose([got[i] for i in range(300)], expected)
    assert ((expected > 0.5) == (y == 1)).mean() > max(y.mean(), 1 - y.mean())


def test_steps_read_rows_once_and_scores_need_no_shuffle(folded, capsys):
    from lexgrain.operators.fold_models import _newton_sums

    _newton_sums(folded, FEATURES, np.zeros((4, 4)), [(0, 0)]).explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD") == 1
    fitted = FoldModels(FEATURES, ((0.0, 1.0, 2.0, 3.0),) * 4)
    fitted.scores(folded).explain()
    fitted.out_of_fold(folded).explain()
    out = capsys.readouterr().out  # the exchanges of the fixture's own repartition
    assert out.count("Exchange") == 2 and out.count("Scan ExistingRDD") == 2


def test_saved_models_score_like_the_fitted_ones(spark, folded, tmp_path):
    ship_package(spark)
    fitted = FoldModels.fit(folded, FEATURES, k=4)
    path = f"file://{tmp_path}/models/weights.npy"
    fitted.save(path)
    assert FoldModels.load(path, FEATURES) == fitted
    score = models.batch_scorer(stored_scorer(path), width=3, batch_size=7)
    from pyspark.sql import functions as F

    got = {r["id"]: r["s"] for r in folded.select("id", score(F.array(*FEATURES)).alias("s")).collect()}
    logits = fitted.scores(folded)
    assert {(r["l0"], r["model"]) for r in logits.collect()} == {(0.0, "a")}
    for r in logits.collect():
        assert got[r["id"]][r["fold"]] == pytest.approx(r["l1"], abs=1e-12)
    mean = {r["id"]: r["pred_prob"] for r in mean_logit(logits).collect()}
    assert mean[5] == pytest.approx(1 / (1 + np.exp(-np.mean(got[5]))))


def test_nulls_single_class_and_no_rows(spark):
    ddl = "id long, label int, fold int, a double"
    some = [(i, i % 2, i % 2, float(i)) for i in range(10)] + [(10, None, 0, 1.0), (11, 1, None, 1.0), (12, 1, 0, None)]
    with_nulls = FoldModels.fit(spark.createDataFrame(some, ddl), ("a",), k=2)
    without = FoldModels.fit(spark.createDataFrame(some[:10], ddl), ("a",), k=2)
    assert with_nulls == without and all(np.isfinite(with_nulls.weights).ravel())
    one = [(i, 1, i % 2, float(i)) for i in range(10)]
    assert np.isfinite(FoldModels.fit(spark.createDataFrame(one, ddl), ("a",), k=2, steps=5).weights).all()
    assert FoldModels.fit(spark.createDataFrame([], ddl), ("a",), k=2).weights == ((0.0, 0.0),) * 2


def test_text_shape_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a b  c"), (4, "é日")]
    got = {r["id"]: (r["log_length"], r["space_share"]) for r in with_text_shape(spark.createDataFrame(rows, "id long, sentence string")).collect()}
    assert got[1] == got[2] == (0.0, 0.0)
    assert got[3] == (pytest.approx(np.log(7) / 10), pytest.approx(3 / 7)) and got[4][1] == 0


def counted(spark, rows):
    df = spark.createDataFrame(rows, "id long, sentence string, label int, fold int").repartition(3)
    return models.with_hashed_counts(df, features=64)


def plain_word_models(rows, k, steps, penalty=0.02):
    """Margins of all rows under all models, from dense counts."""
    from pyspark.ml.feature import HashingTF

    hashing = HashingTF(numFeatures=64, inputCol="w", outputCol="tf")
    tf = np.zeros((len(rows), 64))
    for i, r in enumerate(rows):
        for word in (r[1] or "").split():
            tf[i, hashing.indexOf(word)] += 1
    margins = np.zeros((len(rows), k))
    root = np.sqrt((0.5 + penalty) / penalty)
    for m in range(k):
        train = [i for i, r in enumerate(rows) if r[2] is not None and r[3] is not None and r[3] != m]
        frequency = (tf[train] > 0).sum(axis=0)
        x = tf * np.where(frequency >= 2, np.log((len(train) + 1) / (frequency + 1)), 0)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        x = np.hstack([x, np.ones((len(rows), 1))])
        y = np.array([rows[i][2] for i in train])
        ridge = np.array([penalty] * 64 + [0])
        w = ahead = np.zeros(65)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-x[train] @ ahead))
            moved = ahead - (x[train].T @ (p - y) / len(train) + ridge * ahead) / (0.5 + penalty)
            w, ahead = moved, moved + (root - 1) / (root + 1) * (moved - w)
        margins[:, m] = x @ w
    return margins


def test_word_counts_are_weighed_in_bounded_parts(spark, monkeypatch):
    import pyarrow as pa

    from lexgrain.operators import fold_models

    tf = [{"type": 0, "size": 4, "indices": list(range(n)), "values": [1.0] * n} for n in (0, 3, 1, 0, 4, 2)]
    batch = pa.RecordBatch.from_pydict({"tf": tf, "id": list(range(6))}).slice(1)
    idf = np.ones((4, 2))
    weights = np.arange(10.0).reshape(5, 2)
    whole = fold_models._weighed(batch, idf, weights)[3]
    assert np.allclose(whole[:2], [[8 + 6 / 3**0.5, 9 + 9 / 3**0.5], [8, 10]])
    for most in (1, 4, 100):
        monkeypatch.setattr(fold_models, "MOST_COUNTS", most)
        parts = list(fold_models._parts(batch))
        assert [i for p in parts for i in p.column("id").to_pylist()] == [1, 2, 3, 4, 5]
        assert len(parts) == {1: 4, 4: 3, 100: 1}[most]
        assert np.allclose(np.vstack([fold_models._weighed(p, idf, weights)[3] for p in parts]), whole)


def test_word_models_equal_plain_ones(spark):
    ship_package(spark)
    pick = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(pick.choice(words[i % 2 * 5 :], 6)), i % 2, i % 3) for i in range(40)]
    rows += [(40, None, 1, 0), (41, "", 0, 1), (42, "w1 w2", None, 2), (43, "w3 w4", 1, None), (43, "w3 w9", 0, 1)]
    folded = counted(spark, rows)
    fitted = WordFoldModels.fit(folded, k=3, slots=64, steps=8)
    expected = plain_word_models(rows, 3, 8)
    got = sorted((r["id"], r["fold"], r["l1"]) for r in fitted.scores(folded).collect())
    want = sorted((r[0], m, expected[i, m]) for i, r in enumerate(rows) for m in range(3))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)
    own = {(r["id"], r["fold"]): r["pred_prob"] for r in fitted.out_of_fold(folded).collect()}
    assert own[43, None] is None and len(own) == len(rows)
    for i, r in enumerate(rows):
        if r[3] is not None:
            assert own[r[0], r[3]] == pytest.approx(1 / (1 + np.exp(-expected[i, r[3]])))


def test_word_models_without_rows(spark):
    ship_package(spark)
    none = counted(spark, [(1, "a b", 1, 0)]).limit(0)
    fitted = WordFoldModels.fit(none, k=2, slots=64, steps=2)
    assert not fitted.weights.any() and not fitted.constants.any()
    assert fitted.out_of_fold(none).collect() == []


@pytest.fixture(scope="module")
def same_form(spark, tmp_path_factory):
    """Texts of one form, whose words alone tell the label; ids from 80 have no label."""
    folder = str(tmp_path_factory.mktemp("same-form"))
    texts = [(i, "good fine nice" if i % 2 else "vile poor base") for i in range(100)]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' as lang").write.parquet(
        f"{folder}/documents.parquet"
    )
    labels = [(i, i % 2) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_oof_generate_reads_the_words(spark, same_form):
    from lexgrain.plans.queries import oof_generate

    rows = oof_generate(spark, same_form).collect()
    assert len(rows) == 80 and all((r["pred_prob"] > 0.5) == (r["label"] == 1) for r in rows)


def test_fold_test_scores_read_the_words(spark, same_form):
    from lexgrain.plans.queries import fold_test_scores

    rows = fold_test_scores(spark, same_form).collect()
    assert len(rows) == 20 and all(r["label"] == r["id"] % 2 and r["n_folds"] == 5 for r in rows)
