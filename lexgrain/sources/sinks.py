"""Sinks for predictions, out-of-fold sets and fold logits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, single_file: bool = False, crlf: bool = False) -> None:
    """CSV with a header; one file only on request, since that means one writing task."""
    rows = df.coalesce(1) if single_file else df
    writer = rows.write.mode("errorifexists").option("header", True)
    if crlf:
        writer = writer.option("lineSep", "\r\n")
    writer.csv(path)


def write_predictions(
    df: DataFrame, path: str, id: str = "id", target: str = "target", name: str = "target", **options
) -> None:
    """Write ``id`` and the prediction, which is called ``name`` in the file."""
    write_csv(df.select(df[id].alias("id"), df[target].cast("int").alias(name)), path, **options)


def write_oof(df: DataFrame, path: str, **options) -> None:
    """Write ``id, label, pred_prob`` in id order."""
    write_csv(df.select("id", "label", "pred_prob").orderBy("id"), path, **options)


def write_fold_logits(df: DataFrame, path: str, by: tuple[str, ...] = ("model", "fold")) -> None:
    """Parquet in ``model=/fold=`` folders."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
