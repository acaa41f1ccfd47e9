import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrain.operators import quantiles
from lexgrain.operators.quantiles import exact_quantiles


def expected(values, p):
    return float(np.percentile(np.array(values, dtype=float), 100 * p))


def found(df, *args, **options):
    rows = exact_quantiles(df, *args, **options).collect()
    return {(r["g"], r["metric"], r["probability"]): (r["n"], r["value"]) for r in rows}


@pytest.mark.parametrize("at_most", [1, 50, 100_000])
def test_equal_to_sorting_whatever_the_bound(spark, at_most):
    """Continuous values, values with heavy ties, and a group with most of the rows."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(4000):
        group = None if i % 40 == 0 else "rare" if i % 10 == 0 else "hot"
        tied = float(rng.choice([0.0, -0.0, 0.25, 1.0], p=[0.3, 0.3, 0.3, 0.1]))
        rows.append((group, float(rng.normal()), tied if i % 7 else float(rng.random())))
    df = spark.createDataFrame(rows, "g string, smooth double, tied double").repartition(5)
    wanted = (0.0, 0.01, 0.25, 0.5, 0.75, 1.0)
    got = found(df, ["smooth", "tied"], wanted, by=("g",), at_most=at_most)
    assert len(got) == 3 * 2 * len(wanted)
    for (group, metric, p), (n, value) in got.items():
        column = [r[1 if metric == "smooth" else 2] for r in rows if r[0] == group]
        assert n == len(column) and value == pytest.approx(expected(column, p), abs=1e-12)


def test_nulls_nan_and_groups_without_values(spark):
    nan = float("nan")
    rows = [("a", 1.0), ("a", None), ("a", nan), ("a", 2.0), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = found(df, ["x"], (0.5,), by=("g",))
    assert got == {("a", "x", 0.5): (2, 1.5), ("c", "x", 0.5): (1, 7.0)}
    assert exact_quantiles(df.where("false"), ["x"], by=("g",)).collect() == []


def test_without_groups_and_with_clashing_names(spark):
    df = spark.range(101).selectExpr("id / 10.0D as value", "id as n", "id as metric")
    rows = exact_quantiles(df, ["value", "n"], (0.5,)).collect()
    assert {(r["metric"], r["value"]) for r in rows} == {("value", 5.0), ("n", 50.0)}


def test_a_sketch_that_errs_is_corrected(spark, monkeypatch):
    """Brackets beside the rank are found out by the exact counts of the next pass."""
    real = F.percentile_approx
    calls = []

    def shifted(column, grid, accuracy):
        calls.append(1)
        return real(column, [min(g + 0.3, 1.0) for g in grid] if len(calls) == 1 else grid, accuracy)

    monkeypatch.setattr(quantiles.F, "percentile_approx", shifted)
    df = spark.range(5000).selectExpr("sqrt(id) as x", "1 as g")
    got = found(df, ["x"], (0.2, 0.5), by=("g",), at_most=10)
    values = np.sqrt(np.arange(5000))
    assert got[(1, "x", 0.5)][1] == pytest.approx(expected(values, 0.5))
    assert got[(1, "x", 0.2)][1] == pytest.approx(expected(values, 0.2)) and len(calls) > 2
