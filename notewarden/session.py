"""Session settings and the two guards used across the library: where to cut
lineage, and when a side is small enough to broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rule tables (names, terms, standards) above this many rows take the
#: shuffled-join way instead of being compiled into expressions.
MAX_RULE_ROWS = 10_000


def build_session(app: str = "notewarden", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long rule chains build many expressions; do not record a call site for each
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; only a local master without one
    gets a temporary folder."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and pins partition ids."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_RULE_ROWS) -> DataFrame:
    """Broadcast hint behind a bounded row count; a larger side is returned
    unhinted so that Spark shuffles it (AQE splits skewed partitions)."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def bounded_rows(df: DataFrame, max_rows: int = MAX_RULE_ROWS) -> list | None:
    """Rows of a small rule table, or None when it is larger than the bound."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
