"""Registry of queries: a Spark callable, the operators it shows, and SQL that
must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Spreading a table: tasks for each core, and rows of one task.
TASKS_PER_CORE, ROWS_PER_TASK = 4, 5_000

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Callable[["Tables"], DataFrame]], Callable]:
    def register(fn):
        REGISTRY[fn.__name__] = Query(
            fn.__name__, tuple(operators.split()), lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql
        )
        return fn

    return register


class Tables:
    """The given parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for text-heavy work.  One of few splits - a small file whose rows
        become pages of notes - is spread over the cores, in parts of a bounded number
        of rows; one of many is read as it is and nothing is shuffled."""
        df = getattr(self, name)
        cores = TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
        return df.repartition(max(cores, -(-df.count() // ROWS_PER_TASK)))
