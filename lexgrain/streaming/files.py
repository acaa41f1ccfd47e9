"""Row functions over files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Apply ``transform`` to the Parquet files of ``source`` not yet processed; return all rows.

    A call works off what is there now in batches of ``files_per_batch`` files and ends.  The next
    call with the same ``checkpoint`` goes on with newer files, or after a failure with the batch
    that failed.  The file sink lists finished batches, so a row is in the result once however
    often its batch is tried.  ``transform`` may use row functions, model scores and joins with
    stored tables; it keeps no state.  ``source`` is a folder or a pattern; without rows there the
    result is empty.

    ``target`` and ``checkpoint`` belong together and lie in storage that all executors share.
    """
    arriving = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    rows = transform(arriving)
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)
