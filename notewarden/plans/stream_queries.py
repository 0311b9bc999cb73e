"""Incremental runs with the given tables as the arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import redact as X
from ..session import ensure_checkpoint_dir
from ..streaming import incremental as I
from .redaction_queries import KINDS, _count_chain
from .registry import Tables, query


def scratch(t: Tables, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("T-01 S-05 S-13", f"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars_in, {_count_chain()} FROM documents")
def incremental_redaction(t: Tables):
    out = scratch(t, "redacted")
    stream = I.read_new_files(t.spark, t.sf_dir, t.documents.schema, glob="documents.parquet")
    I.redact_new(stream.select("doc_id", "text"), lambda d: X.apply_rules(d, R.GENERAL_RULES), out, out + "/_state", ["doc_id"])
    audit = t.spark.read.parquet(f"{out}/audit")
    return audit.select(
        "doc_id", F.col("chars_in").cast("long").alias("chars_in"),
        *[F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
    )


@query("T-02 W-03 U-01", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def incremental_merge(t: Tables):
    out = scratch(t, "merged")
    stream = I.read_new_files(t.spark, t.sf_dir, t.orders.schema, glob="orders.parquet")
    I.append_batches(stream.select("o_custkey", "o_orderkey", "o_orderstatus"), out + "/rows", out + "/_state")
    return I.latest_rows(t.spark, out + "/rows", ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("S-01 S-02 S-13", """
SELECT 'source=' || source AS patient_id, CAST(sum(length(replace(text, chr(10), ' ')) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY 1""")
def folder_scan(t: Tables):
    """A folder tree of text files, written from the documents and scanned back:
    the first part of a file's path is its patient."""
    from ..sources.documents import read_text_folder, with_path_keys

    out = scratch(t, "tree")
    d = t.spread("documents").select("source", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    d.write.partitionBy("source").option("maxRecordsPerFile", 10_000).text(out)
    files = with_path_keys(read_text_folder(t.spark, out))
    return files.groupBy("patient_id").agg(F.sum(F.length("text")).alias("n_chars"))
