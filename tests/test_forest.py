import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexgrain.operators import forest, models


def made_rows(n=400, width=6, seed=5):
    """Sparse values with repeats; the label follows two features and some noise."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.5, 0.0, rng.normal(size=(n, width)).round(1))
    x[:, 0] = rng.normal(size=n)
    y = ((x[:, 0] + x[:, 1] > 0.2) ^ (rng.random(n) < 0.15)).astype(int) + (x[:, 2] > 1.0)
    return x, y


def frame(spark, x, y, sparse=True, parts=3):
    def vector(line):
        return Vectors.sparse(len(line), {int(i): float(line[i]) for i in np.flatnonzero(line)}) if sparse else Vectors.dense(line)

    rows = [(i, int(label), vector(line)) for i, (line, label) in enumerate(zip(x, y, strict=True))]
    made = spark.createDataFrame(rows, ["id", "label", "features"])
    return made.repartition(parts, "id").sortWithinPartitions("id")


def brute_tree(bins, y, w, depth, least, classes):
    """Class shares by Gini splits over all features and bins, leaves of one prediction merged."""
    counts = np.bincount(y, w, minlength=classes)
    leaf = ("leaf", counts.argmax(), counts / counts.sum())
    if depth == 0:
        return leaf
    best = (0.0, None)
    base = (counts**2).sum() / counts.sum()
    for f in range(bins.shape[1]):
        for b in range(bins[:, f].max()):
            left = np.bincount(y[bins[:, f] <= b], w[bins[:, f] <= b], minlength=classes)
            right = counts - left
            if left.sum() >= least and right.sum() >= least:
                gain = (left**2).sum() / left.sum() + (right**2).sum() / right.sum() - base
                if gain > best[0] + 1e-9:
                    best = (gain, (f, b))
    if best[1] is None:
        return leaf
    f, b = best[1]
    at = bins[:, f] <= b
    sides = [brute_tree(bins[s], y[s], w[s], depth - 1, least, classes) for s in (at, ~at)]
    if all(s[0] == "leaf" for s in sides) and sides[0][1] == sides[1][1]:
        return leaf
    return ("node", f, b, *sides)


def brute_shares(tree, line):
    while tree[0] == "node":
        tree = tree[3] if line[tree[1]] <= tree[2] else tree[4]
    return tree[2]


class Kept(forest._Rows):
    """Rows in memory instead of mapped files."""

    def __init__(self, parts):
        self.parts = parts
        self.starts = np.cumsum([0, *(len(p.label) for p in parts)])
        self.n = int(self.starts[-1])
        self.label = np.concatenate([p.label for p in parts])


def as_arrow(x):
    listed = [{"type": 0, "size": len(r), "indices": np.flatnonzero(r).tolist(), "values": r[np.flatnonzero(r)].tolist()} for r in x]
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    return pa.array(listed, kind)


@pytest.mark.parametrize("block_rows, at_once", [(1 << 12, 1 << 14), (1, 1 << 14), (40, 7), (1, 64)])
def test_tree_equals_brute_force(monkeypatch, block_rows, at_once):
    monkeypatch.setattr(forest, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(forest, "ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(forest, "CANDIDATES_AT_ONCE", 3)
    x, y = made_rows()
    points = forest._all_split_points(as_arrow(x), x.shape[1], 32)
    zero = forest._zero_bins(points)
    bins = np.stack([np.searchsorted(points[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    parts = []
    for a, b in ((0, 150), (150, 151), (151, 400)):
        row, feature, found = forest._binned(as_arrow(x[a:b]), points, zero)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b - a))])
        parts.append(forest._Part(ends, feature.astype(np.uint16), found, y[a:b].astype(np.uint16)))
    setting = forest._Setting(trees=1, max_depth=6, least=2, seed=9, classes=3, features_per_node=x.shape[1])
    grower = forest._Grower(Kept(parts), zero, points.shape[1] + 1, setting, 0)
    weight = grower.weight.astype(int)
    tree = grower.grow()
    drawn = weight > 0
    brute = brute_tree(bins[drawn], y[drawn], weight[drawn], 6, 2, 3)
    assert len(tree) > 20
    found = forest._votes(as_arrow(x), points, [tree], 3)
    assert np.allclose(found, [brute_shares(brute, line) for line in bins])


def test_split_points_are_those_of_spark(spark):
    x, y = made_rows(n=600)
    points = forest._all_split_points(as_arrow(x), x.shape[1], 32)
    model = RandomForestClassifier(numTrees=30, maxDepth=8, seed=1).fit(frame(spark, x, y))
    used = re.findall(r"feature (\d+) <= ([-\d.E]+)", model.toDebugString)
    assert len(used) > 200
    for feature, point in used:
        assert np.isclose(points[int(feature)], float(point), rtol=1e-12, atol=0).any()


def test_draws_are_distinct_and_even():
    setting = forest._Setting(trees=1, max_depth=6, least=2, seed=9, classes=2, features_per_node=9)
    empty = forest._Part(np.zeros(1, int), np.zeros(0, np.uint16), np.zeros(0, np.uint8), np.zeros(0, np.uint16))
    grower = forest._Grower(Kept([empty]), np.zeros(40, np.uint8), 2, setting, 0)
    drawn = grower._draw(4000)
    assert drawn.shape == (4000, 9) and all(len(set(line)) == 9 for line in drawn.tolist())
    assert np.allclose(np.bincount(drawn.ravel(), minlength=40), 900, atol=150)


def test_forest_learns_like_that_of_spark(spark):
    x, y = made_rows(n=1500)
    train, test = frame(spark, x[:1000], y[:1000]), frame(spark, x[1000:], y[1000:])
    own = models.forest(trees=40).fit(train)
    other = RandomForestClassifier(numTrees=40, maxDepth=20, minInstancesPerNode=2, seed=42).fit(train)

    def accuracy(model):
        return model.transform(test).where("label = prediction").count() / 500

    assert abs(accuracy(own) - accuracy(other)) < 0.05 and accuracy(own) > 0.7
    nodes = sum(own.node_counts()), sum(tree.numNodes for tree in other.trees)
    assert abs(nodes[0] / nodes[1] - 1) < 0.1
    scored = own.transform(test).select("rawPrediction", "probability", "prediction").collect()
    for row in scored:
        assert row["rawPrediction"].toArray().sum() == pytest.approx(40)
        assert row["probability"].toArray().sum() == pytest.approx(1)
        assert row["prediction"] == row["probability"].toArray().argmax()


def test_fit_is_the_same_for_dense_and_sparse_vectors(spark):
    x, y = made_rows()
    first = models.forest(trees=5).fit(frame(spark, x, y))
    rows = frame(spark, x, y)
    expected = sorted(first.transform(rows).select("id", "probability").collect())
    assert len({tuple(r["probability"]) for r in expected}) > 20
    again = models.forest(trees=5).fit(frame(spark, x, y, sparse=False))
    assert sorted(again.transform(rows).select("id", "probability").collect()) == expected


def test_jobs_of_a_fit_do_not_grow_with_its_nodes(spark):
    """Each level of Spark ML's forest was a job whose tasks sent the statistics of all its nodes."""
    x, y = made_rows(n=800)
    rows = frame(spark, x, y).persist()
    assert rows.count() == 800
    context = spark.sparkContext

    def jobs(n):
        context.setJobGroup(f"forest-{n}", "")
        models.forest(trees=4).fit(rows.where(F.col("id") < n))
        return len(context.statusTracker().getJobIdsForGroup(f"forest-{n}"))

    try:
        assert jobs(20) == jobs(800)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        rows.unpersist()


@pytest.mark.parametrize("label, message", [(None, "got null"), (-1, "got -1"), (0.5, "got 0.5")])
def test_labels_that_are_no_classes_are_rejected(spark, label, message):
    rows = frame(spark, *made_rows(n=20)).withColumn("label", F.col("label").cast("double"))
    wrong = rows.withColumn("label", F.when(F.col("id") == 7, F.lit(label)).otherwise(F.col("label")))
    with pytest.raises(Exception, match=message):
        models.forest(trees=2).fit(wrong)
