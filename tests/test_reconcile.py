"""Reconciliation against the report that compares all rows."""

import random

from pyspark.sql import functions as F

from lexgrain.operators import reconcile
from lexgrain.operators.ensemble import alignment_report

SCHEMA = "id long, label int"


def both(spark, a, b, **options):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    return (
        tuple(reconcile.reconciliation_report(left, right, **options).first()),
        tuple(alignment_report(left, right).first()),
    )


def test_random_sets_give_the_same_report(spark):
    draw = random.Random(3)
    for case in range(4):
        a = [(draw.choice([None, *range(300)]), draw.choice([0, 1, None])) for _ in range(400)]
        b = list(a)
        for _ in range(case * 5):
            b[draw.randrange(len(b))] = (draw.randrange(400), draw.choice([0, 1, None]))
        draw.shuffle(b)
        got, expected = both(spark, a, b, levels=(3, 6))
        assert got == expected


def test_edges(spark):
    unique = [(i, i % 2) for i in range(50)]
    for a, b in [
        ([], []),
        (unique, []),
        ([], unique),
        (unique, unique[::-1]),
        ([(None, None)], [(None, 0)]),
        ([(1, None)], [(None, 1)]),
        ([(1, 0), (1, 0), (2, 1)], [(1, 0), (2, 1), (2, 1)]),  # equal sets, other counts
    ]:
        got, expected = both(spark, a, b)
        assert got == expected
    got, expected = both(spark, unique, unique[:-1] + [(49, 0)], unique_ids=True)
    assert got == expected == (0, 0, 1, 0, 50)


def test_only_rows_of_differing_ranges_are_compared(spark):
    a = spark.range(20_000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    b = a.withColumn("label", F.when(F.col("id").isin(7, 4711), 1 - F.col("label")).otherwise(F.col("label")))
    assert {r["_id"] for r in reconcile.differing_rows(a, b).collect()} == {7, 4711}
    assert reconcile.differing_rows(a, a.orderBy(F.desc("id"))).isEmpty()


def test_types_of_the_sides_may_differ(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, label long")
    b = spark.createDataFrame([(2, 1), (1, 0)], SCHEMA)
    assert tuple(reconcile.reconciliation_report(a, b, unique_ids=True).first()) == (0, 0, 0, 0, 2)
