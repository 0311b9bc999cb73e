"""Pathway variance on a cohort of care episodes derived from events.

An episode is a user's three-day span.  Its record holds one field per event
type (NULL without an event, 'tidak' when its largest value is small), the stay
in whole days, a number and a code for the other kinds of standard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variance as V
from ..operators.variance import Standard, StayTarget
from .registry import Tables, query

CP_NAME = "Episode"
TARGET = StayTarget(1, 1)
STANDARDS = [
    Standard("Wajib", "click", "ada", "Klik", "wajib", "Aksi"),
    Standard("Wajib", "purchase", "ada", "Beli", "wajib", "Aksi"),
    Standard("Wajib", "lama_rawat_hari", "ada", "Lama", "wajib", "Outcome"),
    Standard("Anjuran", "view", "ada", "Lihat", "rekomendasi", "Aksi"),
    Standard("Anjuran", "error", "ada", "Galat", "rekomendasi", "Sistem"),
    Standard("Nilai", "n_events", "7", "Jumlah", "wajib", "Nilai", "numeric"),
    Standard("Nilai", "first_type", " Click ", "Awal", "rekomendasi", "Nilai", "string"),
    Standard("Nilai", "kode", "x", "Kode", "rekomendasi", "Nilai", "other"),
]


def episode_record(t: Tables):
    """Long ``(episode, field, value)``.  One aggregation per (episode, type);
    episodes have few events, and partial sums combine before the shuffle."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    e = t.events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(day / 3).cast("string")).alias("patient_id"), "event_type", "value", "ts", "event_id"
    )
    per_type = e.groupBy("patient_id", "event_type").agg(F.max("value").alias("m")).select(
        "patient_id", F.col("event_type").alias("field"), F.when(F.col("m") < 15, "tidak").otherwise("ada").alias("value")
    )
    per_episode = e.groupBy("patient_id").agg(
        F.timestamp_diff("DAY", F.min("ts"), F.max("ts")).cast("string").alias("stay"),
        F.count(F.lit(1)).cast("string").alias("n"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"),
    )
    rest = per_episode.select(
        "patient_id",
        F.explode(
            F.array(
                F.struct(F.lit("lama_rawat_hari").alias("field"), F.col("stay").alias("value")),
                F.struct(F.lit("n_events").alias("field"), F.when(F.col("n") == "6", "enam").otherwise(F.col("n")).alias("value")),
                F.struct(F.lit("first_type").alias("field"), F.col("first_type").alias("value")),
                F.struct(F.lit("kode").alias("field"), F.lit("x").alias("value")),
            )
        ).alias("r"),
    ).select("patient_id", "r.*")
    return per_type.unionByName(rest)


RECORD_SQL = """
e AS (SELECT user_id || '-' || CAST(floor(floor((epoch_us(ts) // 1000000 - 1704067200) / 86400) / 3) AS BIGINT) AS patient_id, event_type, value, ts, event_id FROM events),
p AS (SELECT patient_id, max(value) FILTER (event_type = 'click') AS c, max(value) FILTER (event_type = 'purchase') AS p, max(value) FILTER (event_type = 'view') AS v,
 max(value) FILTER (event_type = 'error') AS e, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS stay, count(*) AS n,
 first(event_type ORDER BY ts, event_id) AS ft FROM e GROUP BY 1),
x AS (SELECT patient_id, stay, CASE WHEN c IS NULL THEN NULL WHEN c < 15 THEN 'tidak' ELSE 'ada' END AS c, CASE WHEN p IS NULL THEN NULL WHEN p < 15 THEN 'tidak' ELSE 'ada' END AS p,
 CASE WHEN v IS NULL THEN NULL WHEN v < 15 THEN 'tidak' ELSE 'ada' END AS v, CASE WHEN e IS NULL THEN NULL WHEN e < 15 THEN 'tidak' ELSE 'ada' END AS e,
 CASE WHEN n = 6 THEN 'enam' ELSE CAST(n AS VARCHAR) END AS n, ft FROM p),
a AS (
 SELECT patient_id, stay, 0 AS item_pos, 'Wajib' AS section, 'click' AS field, 'Klik' AS label, 'wajib' AS severity, c AS actual, 'ada' AS kind FROM x
 UNION ALL SELECT patient_id, stay, 1, 'Wajib', 'purchase', 'Beli', 'wajib', p, 'ada' FROM x
 UNION ALL SELECT patient_id, stay, 2, 'Wajib', 'lama_rawat_hari', 'Lama', 'wajib', CAST(stay AS VARCHAR), 'ada' FROM x
 UNION ALL SELECT patient_id, stay, 3, 'Anjuran', 'view', 'Lihat', 'rekomendasi', v, 'ada' FROM x
 UNION ALL SELECT patient_id, stay, 4, 'Anjuran', 'error', 'Galat', 'rekomendasi', e, 'ada' FROM x
 UNION ALL SELECT patient_id, stay, 5, 'Nilai', 'n_events', 'Jumlah', 'wajib', n, 'numeric' FROM x
 UNION ALL SELECT patient_id, stay, 6, 'Nilai', 'first_type', 'Awal', 'rekomendasi', ft, 'string' FROM x
 UNION ALL SELECT patient_id, stay, 7, 'Nilai', 'kode', 'Kode', 'rekomendasi', 'x', 'other' FROM x),
f AS (SELECT patient_id, stay, item_pos, section, field, label, severity, actual,
  CASE kind WHEN 'ada' THEN CASE WHEN actual IS NULL THEN 'missing' WHEN actual = 'tidak' THEN 'deviation' ELSE 'compliant' END
   WHEN 'numeric' THEN CASE WHEN actual = 'enam' THEN 'not_assessable' WHEN actual = '7' THEN 'compliant' ELSE 'deviation' END
   WHEN 'string' THEN CASE WHEN lower(actual) = 'click' THEN 'compliant' ELSE 'deviation' END ELSE 'not_assessable' END AS variance_type FROM a
 UNION ALL SELECT patient_id, stay, 1000000, 'LOS Target', 'lama_rawat_hari', 'Lama Rawat (Target CP)', CASE WHEN stay < 1 THEN 'rekomendasi' ELSE 'wajib' END,
  CAST(CAST(stay AS DOUBLE) AS VARCHAR), CASE WHEN stay = 1 THEN 'compliant' ELSE 'deviation' END FROM x)"""
SUMMARY_SQL = """,
s AS (SELECT patient_id, count(*) AS total_standards, count(*) FILTER (variance_type = 'compliant') AS compliant, count(*) FILTER (variance_type = 'deviation') AS deviation,
 count(*) FILTER (variance_type = 'missing') AS missing, count(*) FILTER (variance_type = 'not_assessable') AS not_assessable,
 count(*) FILTER (severity = 'wajib' AND variance_type IN ('missing','deviation')) AS wajib_missing_count, CAST(max(stay) AS DOUBLE) AS los_actual FROM f GROUP BY 1)"""
VERDICT = """CASE WHEN los_actual < 1 THEN 'Di bawah target (' || CAST(los_actual AS BIGINT) || ' < 1 hari)' WHEN los_actual > 1
 THEN 'Di atas target (' || CAST(los_actual AS BIGINT) || ' > 1 hari)' ELSE 'Sesuai target (1-1 hari)' END"""
FIELDS_SQL = """,
g AS (SELECT field, arg_min(label, item_pos) AS label, arg_min(severity, item_pos) AS severity, arg_min(section, item_pos) AS section,
 count(*) FILTER (variance_type = 'compliant') AS compliant, count(*) FILTER (variance_type = 'deviation') AS deviation, count(*) FILTER (variance_type = 'missing') AS missing,
 count(*) FILTER (variance_type = 'not_assessable') AS not_assessable, count(*) AS total FROM f GROUP BY 1),
h AS (SELECT *, coalesce(100.0 * CAST(compliant AS DOUBLE) / nullif(compliant + deviation + missing, 0), 0.0) AS compliance_pct FROM g)"""


def facts(t: Tables):
    return V.compare(episode_record(t), STANDARDS, TARGET)


@query("J-01 A-01 A-02 A-12", f"WITH {RECORD_SQL} SELECT patient_id, section, field, label, severity, actual, variance_type FROM f")
def variance_detail(t: Tables):
    return facts(t).select("patient_id", "section", "field", "label", "severity", "actual", "variance_type")


@query("A-03 A-04 A-07 A-06", f"""WITH {RECORD_SQL}{SUMMARY_SQL}
SELECT patient_id, 'Episode' AS cp_name, total_standards, compliant, deviation, missing, not_assessable,
 coalesce(100.0 * CAST(compliant AS DOUBLE) / nullif(compliant + deviation + missing, 0), 0.0) AS compliance_rate_pct, wajib_missing_count, los_actual, '1-1' AS los_target, {VERDICT} AS los_variance FROM s""")
def patient_summary(t: Tables):
    return V.patient_summary(facts(t), CP_NAME, TARGET)


@query("A-05", f"""WITH {RECORD_SQL} SELECT patient_id, count(*) AS n_gaps, string_agg(label, '; ' ORDER BY item_pos) AS gaps FROM f
WHERE severity = 'wajib' AND variance_type IN ('missing','deviation') GROUP BY 1""")
def mandatory_gaps(t: Tables):
    return V.mandatory_gaps(facts(t))


@query("A-08", f"""WITH {RECORD_SQL}{SUMMARY_SQL}
SELECT count(*) AS patients, round(avg(coalesce(100.0 * CAST(compliant AS DOUBLE) / nullif(compliant + deviation + missing, 0), 0.0)), 6) AS avg_compliance_rate,
 CAST(sum(deviation) AS BIGINT) AS total_deviation, CAST(sum(missing) AS BIGINT) AS total_missing FROM s""")
def cohort_summary(t: Tables):
    return V.cohort_summary(V.patient_summary(facts(t), CP_NAME, TARGET)).withColumn("avg_compliance_rate", F.round("avg_compliance_rate", 6))


@query("A-09", f"WITH {RECORD_SQL}{FIELDS_SQL} SELECT field, label, severity, section, compliant, deviation, missing, not_assessable, total, compliance_pct FROM h")
def field_compliance(t: Tables):
    return V.field_compliance(facts(t)).drop("category")


@query("A-09", f"""WITH {RECORD_SQL} SELECT section, field, count(*) AS total, count(*) FILTER (variance_type = 'compliant') AS compliant FROM f GROUP BY 1, 2""")
def section_compliance(t: Tables):
    return V.field_compliance(facts(t), by_section=True).select("section", "field", "total", "compliant")


@query("A-10", f"WITH {RECORD_SQL}{FIELDS_SQL} SELECT field, compliant, total, compliance_pct FROM h WHERE severity = 'wajib'")
def mandatory_compliance(t: Tables):
    return V.mandatory_compliance(V.field_compliance(facts(t))).select("field", "compliant", "total", "compliance_pct")


@query("A-13", f"WITH {RECORD_SQL}{FIELDS_SQL} SELECT field, compliance_pct FROM h WHERE compliance_pct < 80 ORDER BY compliance_pct, field")
def low_compliance(t: Tables):
    return V.low_compliance(V.field_compliance(facts(t))).select("field", "compliance_pct")


@query("A-11 W-11", f"""WITH {RECORD_SQL}{SUMMARY_SQL}
SELECT count(los_actual) AS n, avg(los_actual) AS mean, median(los_actual) AS median, min(los_actual) AS min, max(los_actual) AS max,
 count(*) FILTER (los_actual > 1) AS above_target, count(*) FILTER (los_actual < 1) AS below_target,
 count(*) FILTER (los_actual = 1) AS within_target FROM s""")
def los_stats(t: Tables):
    return V.stay_stats(V.patient_summary(facts(t), CP_NAME, TARGET), TARGET)


@query("A-01", f"""WITH {RECORD_SQL} SELECT variance_type, severity, count(*) AS n,
 count(*) FILTER (variance_type = 'missing') AS undocumented FROM f GROUP BY 1, 2""")
def variance_classes(t: Tables):
    noted = F.count_if(F.col("note").endswith("tidak terdokumentasi"))
    return facts(t).groupBy("variance_type", "severity").agg(F.count(F.lit(1)).alias("n"), noted.alias("undocumented"))


@query("S-11 J-05", """
WITH d AS (SELECT DISTINCT o_orderpriority AS disease FROM orders UNION SELECT 'urgent.json' UNION SELECT 'tanpa berkas')
SELECT disease, CASE disease WHEN 'urgent.json' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS rank,
 CASE disease WHEN 'urgent.json' THEN 'urgent.json' WHEN '1-URGENT' THEN 'urgent.json' WHEN '2-HIGH' THEN '2-HIGH.json' WHEN '3-MEDIUM' THEN 'sedang.json' ELSE 'plain.json' END AS file,
 CAST(CASE disease WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 ELSE 2 END AS BIGINT) AS n_standards
FROM d WHERE disease IN ('urgent.json', '1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')""")
def pathway_lookup(t: Tables):
    """Diseases matched to rule files by file name, stem, name or reference; two have none."""
    from ..sources.profiles import catalogue_frame, match_pathways

    field = {"field": "x", "expected": "ada"}
    files = {
        "urgent.json": {"name": "Urgent", "disease_profile_ref": "1-urgent", "standards": {"A": [field, {"field": "y", "expected": 3}]}},
        "2-HIGH.json": {"name": "Tinggi", "standards": {"A": [field]}},
        "sedang.json": {"name": "3-Medium", "disease_profile_ref": "2-high", "standards": {}},
        "plain.json": {"name": "Plain", "disease_profile_ref": "4-not_specified", "standards": {"A": [field], "B": [field]}},
        "late.json": {"name": "Late", "disease_profile_ref": "3-medium", "standards": {}},
    }
    extra = t.spark.createDataFrame([("urgent.json",), ("tanpa berkas",)], "disease string")
    diseases = t.orders.select(F.col("o_orderpriority").alias("disease")).union(extra).distinct()
    return match_pathways(diseases, catalogue_frame(t.spark, files)).select("disease", "rank", "file", F.col("n_standards").cast("long").alias("n_standards"))

