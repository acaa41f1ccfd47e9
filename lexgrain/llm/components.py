"""Written intermediate tables, and connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.session import new_scratch_path


class Scratch:
    """Tables written to the shared folder; ``drop`` removes those that are no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, table: DataFrame) -> DataFrame:
        path = new_scratch_path(self.spark, self.name)
        table.write.parquet(path)
        kept = self.spark.read.schema(table.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, _ = self.paths.pop(id(table))
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of every node in ``links(a, b)``; the component is its smallest node.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    the rounds grow with the logarithm of the longest chain of a component.  Labels are written
    each round; a node with very many links is combined before the shuffle.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = scratch.keep(both)
    labels = scratch.keep(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("component")
        )
    )
    while True:
        near = (
            edges.join(labels, F.col("b") == F.col("node"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("lower")
        )
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("of_root"))
        step = scratch.keep(
            lower.join(roots, F.col("lower") == F.col("root"), "left").select(
                "node",
                F.least("lower", F.coalesce("of_root", "lower")).alias("component"),
                (F.least("lower", F.coalesce("of_root", "lower")) < F.col("component")).alias("moved"),
            )
        )
        moved = step.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = step
        if not moved:
            scratch.drop(edges)
            return labels.select("node", "component")
