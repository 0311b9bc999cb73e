"""Document scans, path keys, answers, and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators.classify import doc_type_by_name


def read_text_folder(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """Recursive scan, one row per file: ``path`` is relative to the folder.
    Files are decoded from bytes, so mixed encodings in one folder are fine."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    )
    # scheme and host are left out on both sides: file:/a, file:///a and /a are one
    scheme = "^[A-Za-z0-9+.-]+:(//[^/]*)?"
    base = re.sub(scheme, "", folder).rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), scheme, "")
    rel = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)
    return raw.select(rel.alias("path"), T.decode_bytes("content").alias("text"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def with_path_keys(df: DataFrame, path: str = "path", root: str = "pasien") -> DataFrame:
    """First path part is the patient, the relative path the file id.  Files at
    the top of the folder form one virtual patient named after the root."""
    p = F.col(path)
    return df.withColumns(
        {"patient_id": F.when(p.contains("/"), F.split_part(p, F.lit("/"), F.lit(1))).otherwise(F.lit(root)), "source_file": p}
    )


def patient_files(df: DataFrame, text: str = "text") -> DataFrame:
    """Normalised, typed documents without the ones that are too short."""
    d = df.withColumn(text, T.normalize(text)).filter(T.long_enough(text))
    return d.withColumns({"doc_type": doc_type_by_name("source_file"), "char_count": F.length(text)})


def discover_patients(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Patient folders: a top folder that holds files or has one leaf is one
    patient, else each leaf is.  Leaves are reduced to distinct rows first."""
    leaves = files.select(F.col(folder).alias("leaf")).distinct().withColumn("top", F.split_part("leaf", F.lit("/"), F.lit(1)))
    tops = leaves.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("leaf") == F.col("top")).alias("holds"))
    whole = F.col("holds") | (F.col("n") == 1)
    return leaves.join(tops, "top").select(F.when(whole, F.col("top")).otherwise(F.col("leaf")).alias("patient_folder")).distinct()


def parse_answer(text: Column | str, schema: str) -> Column:
    """JSON from an answer: fences stripped, else the outermost braces."""
    c = F.trim(T.col(text))
    c = F.regexp_replace(c, r"(?i)^```json\s*", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^```\s*", ""), r"\s*```$", "")
    plain = F.when(c.startswith("{") & c.endswith("}"), c).otherwise(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    return F.from_json(plain, schema)


# ---------------------------------------------------------------------------
# Sinks
# ---------------------------------------------------------------------------
def write_redacted(df: DataFrame, folder: str, mode: str = "overwrite", by_patient: bool = False) -> None:
    """Redacted texts as parquet, path mirrored in ``output_file``.

    Tasks write the rows they hold: no shuffle, and no task grows with a patient.
    ``by_patient`` makes a folder per patient (for few patients); there too a
    large patient is written by all tasks that hold its rows."""
    out = df.withColumn("output_file", F.concat(F.regexp_replace("source_file", r"\.[^./]+$", ""), F.lit(".anon.txt")))
    writer = out.write.mode(mode)
    (writer.partitionBy("patient_id") if by_patient else writer).parquet(folder)


def write_csv(df: DataFrame, folder: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).csv(folder)


def write_json(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(folder)


def write_bundle(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """The result bundle: one table per name (clinical, resume, inventory,
    audit, leaks, log)."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def write_append(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def read_staff_csv(spark: SparkSession, path: str, default_role: str | None = None) -> DataFrame:
    """``name, role`` from a CSV with a header; blanks trimmed."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    clean = raw.select(*[F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in raw.columns])
    role = F.trim("role") if "role" in clean.columns else F.lit("")
    if default_role:
        role = F.coalesce(F.nullif(role, F.lit("")), F.lit(default_role))
    return clean.select(F.trim("name").alias("name"), F.coalesce(role, F.lit("")).alias("role")).filter(F.col("name") != "")


def union_staff(main: DataFrame, extra: DataFrame, default_role: str = "PPA") -> DataFrame:
    filled = extra.withColumn("role", F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit(default_role)))
    return main.unionByName(filled).dropDuplicates(["name", "role"])
