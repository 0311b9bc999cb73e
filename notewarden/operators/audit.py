"""Aggregates over documents, audit rows and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..rows import explode_map

# The ten items of the documentation audit and its two states.
AUDIT_ITEMS = [
    ("Diagnosis stroke tercatat", "diagnosis_stroke"),
    ("Onset tercatat", "onset"),
    ("GCS tercatat & valid", "gcs"),
    ("Tekanan darah awal tercatat", "tekanan_darah_awal"),
    ("GDS tercatat & valid", "gula_darah_sewaktu"),
    ("CT scan tercatat", "hasil_ct_scan"),
    ("Terapi antiplatelet tercatat", "terapi_antiplatelet"),
    ("Statin tercatat", "statin"),
    ("Kondisi pulang tercatat", "kondisi_pulang"),
    ("mRS tercatat", "mrs"),
]
AUDIT_STATES = ("Terpenuhi", "Belum ditemukan")
FEW_VALUES = 5


def count_rows(df: DataFrame, counts: str = "counts", keys: list[str] | None = None) -> DataFrame:
    return explode_map(df, keys or [], counts)


def totals_by_key(df: DataFrame, counts: str = "counts") -> DataFrame:
    """Files with at least one hit and total hits per key."""
    return count_rows(df, counts).groupBy("key").agg(
        F.count_if(F.col("n") > 0).alias("files"), F.sum("n").alias("total")
    )


def replacement_stats(df: DataFrame, counts: str = "counts") -> DataFrame:
    n = F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(n.alias("n")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max")
    )


def any_positive(counts: Column | str) -> Column:
    return F.exists(F.map_values(T.col(counts)), lambda n: n > 0)


def wide_counts(df: DataFrame, keys: list[str], columns: list[str], counts: str = "counts") -> DataFrame:
    """Fixed columns, then one column per count key in sorted order (0 when
    absent).  No shuffle: the key list is given, each column is a map lookup."""
    return df.select(*keys, *[F.coalesce(F.try_element_at(F.col(counts), F.lit(c)), F.lit(0)).alias(c) for c in sorted(columns)])


def count_keys(df: DataFrame, counts: str = "counts", limit: int = 10_000) -> list[str]:
    """Sorted union of the dynamic count keys (bounded by the rule list)."""
    rows = df.select(F.explode(F.map_keys(counts)).alias("k")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} count keys: these are not rule keys")
    return sorted(r["k"] for r in rows)


def audit_totals(df: DataFrame, status: str = "status", patient: str = "patient_id") -> DataFrame:
    s = F.col(status)
    return df.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(s == "AMAN").alias("safe"),
        F.count_if(s == "PERLU_REVIEW").alias("review"),
        F.count_if(s == "ERROR").alias("error"),
        F.count_distinct(F.col(patient)).alias("patients"),
    )


def value_counts(record: DataFrame, max_distinct: int | None = FEW_VALUES) -> DataFrame:
    """Frequencies per field (NULLs dropped), only of fields with few values.
    The distinct count runs over the already aggregated frequencies."""
    freq = record.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    if max_distinct is None:
        return freq
    few = freq.groupBy("field").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= max_distinct)
    return freq.join(few.select("field"), "field", "left_semi")


def unknown_share(record: DataFrame) -> DataFrame:
    unknown = F.col("value").isNull() | (F.col("value") == T.UNKNOWN)
    return record.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(unknown).alias("unknown_cells"),
        (F.lit(100.0) * F.count_if(unknown) / F.count(F.lit(1))).alias("unknown_pct"),
    )


def numeric_stats(record: DataFrame) -> DataFrame:
    n = F.col("value").try_cast("decimal(38,6)")
    return record.groupBy("field").agg(
        F.count(n).alias("n"),
        (F.sum(n).cast("double") / F.count(n)).alias("mean"),
        F.min(n.cast("double")).alias("min"),
        F.max(n.cast("double")).alias("max"),
    )


def category_share(record: DataFrame, present: list[str]) -> DataFrame:
    hit = F.col("value").isin(*present)
    return record.groupBy("field").agg(
        F.count_if(hit).alias("n"), F.count(F.lit(1)).alias("total"), (F.lit(100.0) * F.count_if(hit) / F.count(F.lit(1))).alias("pct")
    )


def invalid_counts(record: DataFrame, marker: str = "invalid") -> DataFrame:
    counted = record.groupBy("field").agg(F.count_if(F.col("value") == marker).alias("n_invalid"))
    return counted.filter(F.col("n_invalid") > 0)


def documentation_audit(wide: DataFrame, keys: list[str], items: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per required item: met when its value is not empty."""
    met, unmet = AUDIT_STATES
    rows = F.array(
        *[
            F.struct(
                F.lit(item).alias("item"),
                F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), met).otherwise(unmet).alias("status"),
                F.coalesce(F.col(c).cast("string"), F.lit("")).alias("note"),
            )
            for item, c in (AUDIT_ITEMS if items is None else items)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def merged_counts(df: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """Key-wise sum of the count maps of a group."""
    summed = count_rows(df, counts, keys).groupBy(*keys, "key").agg(F.sum("n").alias("n"))
    return summed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(counts))


def extraction_log(docs: DataFrame, patient: str = "patient_id", text: str = "text", ocr: str = "ocr_used", counts: str = "counts") -> DataFrame:
    """Status per patient: OCR needed, done with OCR, done; with mask totals."""
    per = docs.groupBy(patient).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.length(text)).alias("n_chars"),
        F.sum(T.nonspace_length(text)).alias("__solid"),
        F.count_if(F.col(ocr)).alias("n_ocr"),
    )
    status = (
        F.when(F.col("__solid") < T.MIN_SOURCE_CHARS, "Perlu OCR manual").when(F.col("n_ocr") > 0, "Selesai (OCR)").otherwise("Selesai")
    )
    masks = merged_counts(docs, [patient], counts)
    return per.join(masks, patient, "left").select(
        patient, status.alias("status"), "n_files", "n_chars", "n_ocr", F.coalesce(F.to_json(counts), F.lit("{}")).alias("masking")
    )
