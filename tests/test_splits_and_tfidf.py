import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrain.operators import splits
from lexgrain.operators.tfidf import PairSketch, TfidfModel, ngram_frequencies, vocabulary


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(503).select("id", F.when(F.col("id") % 7 == 0, 0).otherwise(1).alias("label"))


def test_folds_cover_rows_once_and_are_stratified(samples):
    rows = splits.stratified_kfold(samples, k=5).collect()
    assert sorted(r["id"] for r in rows) == list(range(503))
    for label in (0, 1):
        sizes = Counter(r["fold"] for r in rows if r["label"] == label)
        assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    total = Counter(r["fold"] for r in rows)
    assert max(total.values()) - min(total.values()) <= 1


def test_splits_depend_on_seed_only(samples):
    def folds(df, **kw):
        return {r["id"]: r["fold"] for r in splits.stratified_kfold(df, **kw).collect()}

    base = folds(samples)
    assert folds(samples.repartition(7)) == base
    assert folds(samples, hex_digits=1) == base
    assert folds(samples, seed=1) != base


@pytest.mark.parametrize("n", [2, 3, 35, 503])
def test_holdout_size(samples, n):
    rows = splits.stratified_holdout(samples.where(F.col("id") < n)).collect()
    assert len(rows) == n
    assert sum(r["is_test"] for r in rows) == math.ceil(0.2 * n)
    for label in (0, 1):
        part = [r["is_test"] for r in rows if r["label"] == label]
        assert abs(sum(part) - math.ceil(0.2 * n) * len(part) / n) < 1


def test_id_selection(samples):
    some = samples.where("id < 10").select("id")
    assert splits.select_ids(samples, some).count() == 10
    assert splits.select_ids(samples, some, keep=False).count() == 493


DOCS = ["the cat sat", "the cat ran ran", "the dog", "the bird cat", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id long, sentence string")


def test_frequencies_and_pruning(docs):
    freq = {r["term"]: (r["df"], r["cf"]) for r in ngram_frequencies(docs).collect()}
    assert freq["the"] == (4, 4) and freq["ran"] == (1, 2) and freq["ran ran"] == (1, 1)
    # "the" is in 4 of 5 documents, above 0.7 * 5; terms of a single document go as well.
    kept = vocabulary(docs, max_df=0.7).orderBy("idx").collect()
    assert [(r["term"], r["idx"]) for r in kept] == [("cat", 0), ("the cat", 1)]
    assert kept[0]["idf"] == pytest.approx(math.log(6 / 4) + 1)


def test_tie_at_the_cap_is_alphabetical(spark):
    df = spark.createDataFrame([(0, "bb aa"), (1, "aa bb"), (2, "cc cc")], "id long, sentence string")
    assert [r["term"] for r in vocabulary(df, max_features=1).collect()] == ["aa"]


def test_rows_have_unit_norm_and_vectors_agree(docs):
    model = TfidfModel.fit(docs)
    squares = model.weights(docs).groupBy("id").agg(F.sum(F.pow("weight", F.lit(2))).alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in squares.collect())
    long = {(r["id"], r["term"]): r["weight"] for r in model.weights(docs).collect()}
    for row in model.vectors(docs).collect():
        dense = row["tfidf"].toArray()
        expected = [long.get((row["id"], term), 0.0) for term in model.terms]
        assert np.allclose(dense, expected)


def test_unknown_terms_are_ignored(spark, docs):
    unseen = spark.createDataFrame([(0, "zebra cat"), (1, "zebra"), (2, None)], "id long, sentence string")
    rows = TfidfModel.fit(docs).weights(unseen).collect()
    assert [(r["id"], r["term"], round(r["weight"], 9)) for r in rows] == [(0, "cat", 1.0)]


def brute_force_vocabulary(texts, max_features, min_df=2, max_df=0.95):
    df, cf = Counter(), Counter()
    for text in texts:
        tokens = re.findall(r"\w\w+", text.lower())
        terms = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False)]
        cf.update(terms)
        df.update(set(terms))
    kept = [t for t in cf if min_df <= df[t] <= max_df * len(texts)]
    top = sorted(kept, key=lambda t: (-cf[t], t.encode()))[:max_features]
    return sorted((t, df[t], cf[t]) for t in top)


@pytest.mark.parametrize("max_features", [3, 40, 50, 700, 10**6])
def test_pruned_vocabulary_is_exact(spark, tables, max_features):
    """The pruned count equals a plain count."""
    df = spark.read.parquet(f"{tables}/documents.parquet").withColumnRenamed("text", "sentence")
    texts = [r["sentence"] for r in df.select("sentence").collect()]
    rows = vocabulary(df, max_features=max_features).collect()
    found = sorted((r["term"], r["df"], r["cf"]) for r in rows)
    assert found == brute_force_vocabulary(texts, max_features)


def test_ties_beyond_the_word_list_count_all_pairs(spark):
    texts = ["aa bb cc dd ee ff", "ff ee dd cc bb aa", "aa bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sentence string")
    for k in (1, 2, 3, 4):
        rows = vocabulary(df, max_features=k, max_df=0.7).collect()
        found = sorted((r["term"], r["df"], r["cf"]) for r in rows)
        assert found == brute_force_vocabulary(texts, k, max_df=0.7)


@pytest.mark.parametrize("width_bits", [6, 12])
def test_crowded_sketches_lose_no_pair(spark, tables, width_bits):
    """Many pairs share a slot; the recount corrects what the sketch lets through."""
    df = spark.read.parquet(f"{tables}/documents.parquet").withColumnRenamed("text", "sentence")
    texts = [r["sentence"] for r in df.select("sentence").collect()]
    rows = vocabulary(df, max_features=700, width_bits=width_bits).collect()
    assert sorted((r["term"], r["df"], r["cf"]) for r in rows) == brute_force_vocabulary(texts, 700)


def test_sketch_never_counts_too_little_and_keeps_its_bound(spark):
    pairs = [f"p{i} q" for i in range(3000) for _ in range(1 + (i < 20) * 500)]
    df = spark.createDataFrame([(p,) for p in pairs], "pair string").repartition(6)
    sketch = PairSketch(10)
    slots = df.select(F.explode(F.array(*sketch.slots(F.col("pair")))).alias("slot"))
    counts = {r["slot"]: r["n"] for r in slots.groupBy("slot").agg(F.count("*").alias("n")).collect()}
    slot_of = df.distinct().select("pair", F.array(*sketch.slots(F.col("pair"))).alias("s")).collect()
    real = Counter(pairs)
    estimates = {r["pair"]: min(counts[s] for s in r["s"]) for r in slot_of}
    assert all(estimates[p] >= real[p] for p in real)
    too_much = sum(estimates[p] - real[p] > math.e * len(pairs) / 1024 for p in real)
    assert too_much / len(real) <= math.exp(-PairSketch.ROWS)
    table = spark.createDataFrame(list(counts.items()), "slot long, n long")
    words = sketch.packed(table, 400)
    asked = df.groupBy().agg(F.collect_set("pair").alias("all"))
    left = asked.select(F.explode(sketch.may_reach(F.col("all"), words)).alias("p")).collect()
    assert {r["p"] for r in left} == {p for p in real if estimates[p] >= 400}


def test_pairs_are_ruled_out_without_a_join(docs):
    plan = vocabulary(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_width_of_a_sketch_is_checked():
    with pytest.raises(ValueError, match="width_bits"):
        PairSketch(40)
