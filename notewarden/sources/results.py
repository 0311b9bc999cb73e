"""Results of runs on shared storage: data first, then an index that names it.

A run writes its rows under ``data/run_id=R`` and, when they are complete, its index
rows under ``index/run_id=R``.  Readers go by the index, so a run that was cut short is
not seen, and writing a run again replaces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.audit import count_keys, wide_counts


def write_results(df: DataFrame, folder: str, run_id: str, key: str, error: Column | str = "error") -> None:
    """Rows without an error as JSON lines, one index row for every input row: ``key``,
    status, error and the file that holds its result (empty for a failed row)."""
    root = folder.rstrip("/")
    failed = (F.col(error) if isinstance(error, str) else error).isNotNull()
    data = f"{root}/data/run_id={run_id}"
    df.filter(~failed).write.mode("overwrite").json(data)
    stored = df.sparkSession.read.schema(df.select(key).schema).json(data)
    where = stored.select(F.col(key), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    asked = df.select(F.col(key), F.when(failed, "error").otherwise("ok").alias("status"), (F.col(error) if isinstance(error, str) else error).alias("error"))
    where = where.withColumnRenamed(key, "__key")
    index = asked.join(where, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    index.select(key, "status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("file", F.lit("")).alias("file")).write.mode("overwrite").json(f"{root}/index/run_id={run_id}")


def read_index(spark: SparkSession, folder: str, key: str = "source_file", kind: str = "string") -> DataFrame:
    """All runs' index rows: run_id, key, status, error, file."""
    return spark.read.schema(f"{key} {kind}, status string, error string, file string, run_id string").json(f"{folder.rstrip('/')}/index")


def read_results(spark: SparkSession, folder: str, schema: str, key: str = "source_file", kind: str = "string") -> DataFrame:
    """Rows of the runs that the index names; data without an index is not read."""
    runs = read_index(spark, folder, key, kind).select("run_id").distinct()
    data = spark.read.schema(f"{schema}, run_id string").json(f"{folder.rstrip('/')}/data")
    return data.join(runs, "run_id", "left_semi")


FIXED = ["source_file", "output_file", "extraction_status", "chars_in", "chars_out", "needs_manual_review"]


def write_audit_csv(results: DataFrame, folder: str, fixed: list[str] | None = None, maps: tuple[str, ...] = ("counts", "leftovers")) -> list[str]:
    """The audit as CSV with a header: fixed columns, then one for each count key that
    occurs in the data, sorted; 0 where a row lacks the key.

    Keys are found first (a distinct of at most the rules' keys), then the rows are
    written with that schema by the tasks that hold them.  Returns the columns."""
    fixed = fixed or [c for c in FIXED if c in results.columns]
    joined = results.withColumn("__all", F.map_concat(*[F.coalesce(F.col(m), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))) for m in maps]))
    keys = [k for k in count_keys(joined, "__all") if k not in fixed]
    wide_counts(joined, fixed, keys, "__all").write.mode("overwrite").option("header", True).csv(folder)
    return fixed + sorted(keys)
