"""Incremental runs over growing folders.

Each micro-batch is written to its own ``batch_id=N`` folder with overwrite, so a
replayed batch replaces itself: results are exactly-once without locks, and no
batch rewrites what earlier ones wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.merge import keep_last


def read_new_files(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Files that no earlier run of the same checkpoint has seen.  ``glob`` names what
    is read in the folder: files, or folders of files (a table may be either)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # the braces make a plain name a pattern, which may match a file as well as a folder
    return reader.load(f"{folder.rstrip('/')}/{{{glob}}}" if glob else folder)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now, then stop; the next call goes on from there."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()


def redact_new(
    stream: DataFrame, redact: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str], text: str = "text"
) -> None:
    """New documents to redacted texts and audit rows under ``out``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = redact(batch.withColumn("chars_in", F.length(text))).withColumn("chars_out", F.length(text))
        kept = [c for c in done.columns if c not in (text,)]
        # one pass over the texts: both tables are written from the stored result
        done.write.mode("overwrite").parquet(f"{out}/redacted/batch_id={batch_id}")
        stored = batch.sparkSession.read.parquet(f"{out}/redacted/batch_id={batch_id}")
        stored.select(*kept).write.mode("overwrite").parquet(f"{out}/audit/batch_id={batch_id}")

    run_available(stream, handle, checkpoint)


def append_batches(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append-only table of patient rows, one folder per batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available(stream, handle, checkpoint)


def latest_rows(spark: SparkSession, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """The current state: the row of the last batch per key."""
    rows = spark.read.option("mergeSchema", True).parquet(out)
    return keep_last(rows, keys, ["batch_id", *order])


def compact(spark: SparkSession, out: str, target: str, keys: list[str], order: list[str]) -> None:
    """Write the current state to a new folder (never over the one being read)."""
    latest_rows(spark, out, keys, order).drop("batch_id").write.mode("overwrite").parquet(target)
