"""Sizes and overlaps from stored sketches against exact sets, within the stated bound."""

from pyspark.sql import functions as F

from lexgrain.operators import sketches as sk


def _numbers(spark, begin, end, label):
    return spark.range(begin, end).select(
        F.lit(label).alias("label"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("sentence")
    )


def test_estimates_stay_within_the_bound(spark, tmp_path):
    """Sets far larger than a sketch, in parts that overlap, added one after the other."""
    path = str(tmp_path / "sketches")
    log_size = 10
    for part in (_numbers(spark, 0, 40_000, 0), _numbers(spark, 20_000, 60_000, 0), _numbers(spark, 45_000, 90_000, 1)):
        sk.store_sketches(sk.vocabulary_sketches(part, log_size=log_size), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    merged = sk.merged_sketches(stored, log_size=log_size)
    for row in sk.sketched_sizes(merged, log_size=log_size).collect():
        exact, total = {0: (60_000, 80_000), 1: (45_000, 45_000)}[row["label"]]
        assert 0 < row["bound"] < exact * 0.1
        assert abs(row["unique_words"] - exact) <= row["bound"]
        assert row["total_words"] == total
    row = sk.sketched_overlap(merged, log_size=log_size).first()
    for name, exact in (("only_first", 45_000), ("only_second", 30_000), ("shared", 15_000)):
        assert abs(row[name] - exact) <= row["bound"]


def test_small_sets_are_exact(spark):
    rows = [(0, "a b b c"), (1, "C d"), (0, None), (1, ""), (None, "e a"), (2, "f")]
    df = spark.createDataFrame(rows, "label int, sentence string")
    merged = sk.merged_sketches(sk.vocabulary_sketches(df))
    sizes = {r["label"]: (r["unique_words"], r["total_words"], r["bound"]) for r in sk.sketched_sizes(merged).collect()}
    assert sizes == {0: (3, 4, 0), 1: (2, 2, 0), None: (2, 2, 0), 2: (1, 1, 0)}
    assert tuple(sk.sketched_overlap(merged).first()) == (2, 1, 1, 0)
    assert tuple(sk.sketched_overlap(merged, first=0, second=9).first()) == (3, 0, 0, 0)
    assert tuple(sk.sketched_overlap(merged.limit(0)).first()) == (0, 0, 0, 0)
    assert sk.sketched_sizes(merged.limit(0)).collect() == []


def test_words_are_not_shuffled(spark):
    """Exchanges carry labels and partial sketches, dealt by label."""
    rows = spark.createDataFrame([(0, "a b")], "label int, sentence string")
    plan = sk.vocabulary_sketches(rows)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 1 and "hashpartitioning(label" in dealt[0]
