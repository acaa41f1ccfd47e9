import statistics

import numpy as np
import pytest

from lexgrain.operators import profile


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, sentence string, label int")


def words(*counts, label=0):
    return [(i, " ".join(["w"] * n), label) for i, n in enumerate(counts)]


def test_distribution_lists_absent_classes(spark):
    rows = profile.label_distribution(corpus(spark, words(1, 2, 3))).orderBy("label").collect()
    assert [tuple(r) for r in rows] == [(0, 3, 100.0), (1, 0, 0.0)]
    empty = profile.label_distribution(corpus(spark, [])).collect()
    assert all(r["n"] == 0 and r["pct"] is None for r in empty)


def test_lengths(spark):
    rows = {r["metric"]: r for r in profile.length_profile(corpus(spark, words(1, 2, 4, 0))).collect()}
    w = rows["words"]
    assert (w["n"], w["mean"], w["median"], w["min"], w["max"]) == (4, 1.75, 1.5, 0, 4)
    assert w["std"] == pytest.approx(statistics.pstdev([1, 2, 4, 0]))
    assert rows["chars"]["max"] == 7


@pytest.mark.parametrize("counts", [(5, 5, 5), (1, 31), (0, 3, 10, 30), (1, 2, 3, 50, 91)])
def test_histogram_matches_numpy(spark, counts):
    rows = profile.word_histogram(corpus(spark, words(*counts))).orderBy("bin").collect()
    expected, edges = np.histogram(counts, bins=30)
    assert [r["n"] for r in rows] == list(expected)
    assert [r["bin_low"] for r in rows] + [rows[-1]["bin_high"]] == pytest.approx(list(edges))


def test_histogram_uses_the_combined_range(spark):
    rows = words(1, 2) + [(9, "w " * 40, 1)]
    found = {(r["label"], r["bin"]): r["n"] for r in profile.word_histogram(corpus(spark, rows)).collect()}
    assert len(found) == 60 and found[0, 1] == 2 and found[1, 30] == 1 and found[0, 30] == 0


def test_box(spark):
    counts = (1, 2, 3, 4, 100)
    row = profile.box_stats(corpus(spark, words(*counts))).first()
    assert (row["q1"], row["median"], row["q3"]) == tuple(np.percentile(counts, [25, 50, 75]))
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 4.0, 1)
    assert row["mean"] == 22.0 and row["n"] == 5
    out = profile.box_outliers(corpus(spark, words(*counts))).collect()
    assert [(r["value"], r["n"]) for r in out] == [(100, 1)]


VOCAB = [(0, "The cat the", 0), (1, "a cat", 1), (2, "", 1), (3, "dog THE", 1)]


def test_vocabulary(spark):
    df = corpus(spark, VOCAB)
    totals = profile.vocab_totals(df).first()
    assert (totals["unique_words"], totals["total_words"]) == (4, 7)
    assert totals["words_per_sentence"] == 7 / 4
    assert profile.approximate_vocab_size(df).first()[0] == 4
    by_label = {r["label"]: r["unique_words"] for r in profile.vocab_by_label(df).collect()}
    assert by_label == {0: 2, 1: 4}
    overlap = profile.vocab_overlap(df).first()
    assert tuple(overlap) == (0, 2, 2)
    assert profile.vocab_except(df).count() == 0
    assert {r["word"] for r in profile.vocab_intersect(df).collect()} == {"the", "cat"}


def test_top_words_break_ties_by_first_appearance(spark):
    rows = profile.top_words(corpus(spark, VOCAB), k=4).collect()
    assert [(r["word"], r["n"]) for r in rows] == [("the", 3), ("cat", 2), ("a", 1), ("dog", 1)]
    assert rows[0]["pct"] == pytest.approx(300 / 7)


def test_one_dominant_word_and_class(spark):
    df = spark.range(3000).selectExpr(
        "id", "if(id % 3 = 0, concat('hot w', id), 'hot hot') as sentence", "if(id = 7, 0, 1) as label"
    )
    top = profile.top_words(df, k=1).first()
    assert (top["word"], top["n"]) == ("hot", 5000)
    assert profile.vocab_totals(df).first()["unique_words"] == 1001


def test_top_words_of_text_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "y x"), (None, "z")], "id string, sentence string")
    rows = profile.top_words(df, k=2).collect()
    assert [(r["word"], r["n"], r["pct"]) for r in rows] == [("y", 2, 40.0), ("x", 2, 40.0)]


def test_texts_are_scanned_once(spark, tables):
    """With adaptive execution off, so that reused exchanges show in the plan."""
    from lexgrain.plans import queries as q

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("word_histogram", "top_words", "length_profile", "stats_by_label", "vocab_totals", "box_stats"):
            plan = q.QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
            scans = [l for l in plan.splitlines() if "FileScan" in l and "text:string" in l]
            assert len(scans) == 1, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
