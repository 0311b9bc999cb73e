"""Comparison of patient records with pathway standards.

The long record is first reduced to one value per standard field and patient
(one shuffle on the patient, combined on the map side).  The standards are a
small literal list exploded per patient, so there is no cross join, and the
per-patient summaries reuse the same partitioning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Classes, severities, negative words, texts.
COMPLIANT, DEVIATION, MISSING, NOT_ASSESSABLE = "compliant", "deviation", "missing", "not_assessable"
MANDATORY, RECOMMENDED = "wajib", "rekomendasi"
NEGATIVE_WORDS = ["tidak", "negatif", "minus", "-", "belum", "bukan", "tidak ada"]
STAY_FIELD, STAY_LABEL, STAY_SECTION, STAY_CATEGORY = "lama_rawat_hari", "Lama Rawat (Target CP)", "LOS Target", "Outcome"
DEFAULT_THRESHOLD = 80.0


@dataclass(frozen=True)
class Standard:
    """``kind``: 'ada', 'numeric', 'string' or 'other'."""

    section: str
    field: str
    expected: str
    label: str
    severity: str = MANDATORY
    category: str = ""
    kind: str = "ada"


@dataclass(frozen=True)
class StayTarget:
    low: float | None = None
    high: float | None = None


def standards_column(standards: list[Standard]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("item_pos"),
                F.lit(s.section).alias("section"),
                F.lit(s.field).alias("field"),
                F.lit(s.expected).alias("expected"),
                F.lit(s.label).alias("label"),
                F.lit(s.severity).alias("severity"),
                F.lit(s.category).alias("category"),
                F.lit(s.kind).alias("kind"),
            )
            for i, s in enumerate(standards)
        ]
    )


def classify(kind: Column, expected: Column, actual: Column) -> Column:
    low = F.lower(F.trim(actual))
    number, wanted = actual.try_cast("double"), expected.try_cast("double")
    ada = F.when(actual.isNull(), MISSING).when(low.isin(*NEGATIVE_WORDS), DEVIATION).otherwise(COMPLIANT)
    numeric = (
        F.when(number.isNull(), NOT_ASSESSABLE).when(number == wanted, COMPLIANT).otherwise(DEVIATION)
    )
    text = F.when(actual.isNull(), MISSING).when(low == F.lower(F.trim(expected)), COMPLIANT).otherwise(DEVIATION)
    return F.when(kind == "ada", ada).when(kind == "numeric", numeric).when(kind == "string", text).otherwise(NOT_ASSESSABLE)


def note(kind: Column, expected: Column, actual: Column, label: Column) -> Column:
    undocumented = F.concat(label, F.lit(" tidak terdokumentasi"))
    kind_class = classify(kind, expected, actual)
    return (
        F.when(kind_class == COMPLIANT, F.lit("Sesuai standar"))
        .when((kind_class == MISSING), undocumented)
        .when(kind == "ada", F.concat(F.lit("Tidak dilakukan/tidak ada (dokumentasi: '"), actual, F.lit("')")))
        .when((kind == "numeric") & actual.isNull(), F.concat(label, F.lit(" tidak tercatat, tidak bisa dinilai")))
        .when((kind == "numeric") & (kind_class == NOT_ASSESSABLE), F.concat(F.lit("Nilai '"), actual, F.lit("' bukan angka")))
        .when(kind == "numeric", F.concat(F.lit("Nilai: "), actual, F.lit(" (expected: "), expected, F.lit(")")))
        .when(kind == "string", F.concat(F.lit("Dokumentasi: '"), actual, F.lit("' (expected: '"), expected, F.lit("')")))
        .otherwise(F.lit("Tipe standar tidak dikenali"))
    )


def _whole(x: Column | float) -> Column:
    return F.format_string("%.0f", F.lit(x).cast("double") if not isinstance(x, Column) else x)


def stay_verdict(stay: Column, target: StayTarget) -> Column:
    """Text verdict of the stay against its target; NULL when not documented."""
    verdict = F.concat(F.lit("Sesuai target ("), _bound(target.low), F.lit("-"), _bound(target.high), F.lit(" hari)"))
    if target.high is not None:
        verdict = F.when(
            stay > target.high,
            F.concat(F.lit("Di atas target ("), _whole(stay), F.lit(" > "), _whole(target.high), F.lit(" hari)")),
        ).otherwise(verdict)
    if target.low is not None:
        verdict = F.when(
            stay < target.low,
            F.concat(F.lit("Di bawah target ("), _whole(stay), F.lit(" < "), _whole(target.low), F.lit(" hari)")),
        ).otherwise(verdict)
    return F.when(stay.isNotNull(), verdict)


def _bound(x: float | None) -> Column:
    return F.lit("" if x is None else f"{x:.0f}")


def _stay_item(stay: Column, target: StayTarget) -> Column:
    above = (stay > target.high) if target.high is not None else F.lit(False)
    below = (stay < target.low) if target.low is not None else F.lit(False)
    return F.struct(
        F.lit(1_000_000).alias("item_pos"),
        F.lit(STAY_SECTION).alias("section"),
        F.lit(STAY_FIELD).alias("field"),
        F.concat(_bound(target.low), F.lit("-"), _bound(target.high), F.lit(" hari")).alias("expected"),
        F.lit(STAY_LABEL).alias("label"),
        F.when(~above & below, RECOMMENDED).otherwise(MANDATORY).alias("severity"),
        F.lit(STAY_CATEGORY).alias("category"),
        F.when(above | below, DEVIATION).otherwise(COMPLIANT).alias("kind"),
    )


def by_patient(record: DataFrame, standards: list[Standard], patient: str = "patient_id", field: str = "field", value: str = "value") -> DataFrame:
    """One row per patient with ``values MAP<field,value>`` of the standard
    fields and ``stay DOUBLE``.  Patients without any of them are kept."""
    names = sorted({s.field for s in standards} | {STAY_FIELD})
    aggs = [F.max(F.when(F.col(field) == n, F.col(value))).alias(f"__v{i}") for i, n in enumerate(names)]
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"__v{i}"))]
    return record.groupBy(patient).agg(*aggs).select(
        patient, F.create_map(*pairs).alias("values"), F.col(f"__v{names.index(STAY_FIELD)}").try_cast("double").alias("stay")
    )


def compare(
    record: DataFrame, standards: list[Standard], target: StayTarget | None = None, patient: str = "patient_id",
    field: str = "field", value: str = "value",
) -> DataFrame:
    """Fact table: one row per patient and standard, plus the stay row."""
    target = target or StayTarget()
    wide = by_patient(record, standards, patient, field, value)
    items = standards_column(standards)
    if target.low is not None or target.high is not None:
        items = F.when(
            F.col("stay").isNotNull(), F.concat(items, F.array(_stay_item(F.col("stay"), target)))
        ).otherwise(items)
    rows = wide.select(patient, "stay", "values", F.explode(items).alias("s")).select(patient, "stay", "values", "s.*")
    actual = F.element_at("values", F.col("field"))
    stay_row = F.col("section") == STAY_SECTION
    return rows.select(
        patient,
        "stay",
        "item_pos",
        "section",
        "field",
        "label",
        "severity",
        "category",
        "expected",
        F.when(stay_row, F.col("stay").cast("string")).otherwise(actual).alias("actual"),
        F.when(stay_row, F.col("kind")).otherwise(classify(F.col("kind"), F.col("expected"), actual)).alias("variance_type"),
        F.when(stay_row, stay_verdict(F.col("stay"), target))
        .otherwise(note(F.col("kind"), F.col("expected"), actual, F.col("label")))
        .alias("note"),
    )


def _count(kind: str) -> Column:
    return F.count_if(F.col("variance_type") == kind)


def _is_gap() -> Column:
    return (F.col("severity") == MANDATORY) & F.col("variance_type").isin(MISSING, DEVIATION)


def rate(compliant: Column, assessable: Column) -> Column:
    return F.coalesce(F.lit(100.0) * compliant / F.nullif(assessable, F.lit(0)), F.lit(0.0))


def patient_summary(facts: DataFrame, cp_name: str, target: StayTarget | None = None, patient: str = "patient_id") -> DataFrame:
    target = target or StayTarget()
    counted = facts.groupBy(patient).agg(
        F.count(F.lit(1)).alias("total_standards"),
        _count(COMPLIANT).alias("compliant"),
        _count(DEVIATION).alias("deviation"),
        _count(MISSING).alias("missing"),
        _count(NOT_ASSESSABLE).alias("not_assessable"),
        F.count_if(_is_gap()).alias("wajib_missing_count"),
        F.max("stay").alias("los_actual"),
    )
    shown = F.lit(None).cast("string")
    if target.low is not None:
        shown = F.concat(_bound(target.low), F.lit("-"), _bound(target.high))
    return counted.select(
        patient,
        F.lit(cp_name).alias("cp_name"),
        "total_standards",
        "compliant",
        "deviation",
        "missing",
        "not_assessable",
        rate(F.col("compliant"), F.col("compliant") + F.col("deviation") + F.col("missing")).alias("compliance_rate_pct"),
        "wajib_missing_count",
        "los_actual",
        shown.alias("los_target"),
        stay_verdict(F.col("los_actual"), target).alias("los_variance"),
    )


def mandatory_gaps(facts: DataFrame, patient: str = "patient_id") -> DataFrame:
    """Mandatory standards that are missing or deviate; the list per patient is
    bounded by the number of standards."""
    return facts.filter(_is_gap()).groupBy(patient).agg(
        F.count(F.lit(1)).alias("n_gaps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_pos", "label"))), lambda x: x["label"]), "; ").alias("gaps"),
    )


def cohort_summary(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("patients"),
        F.coalesce(F.avg("compliance_rate_pct"), F.lit(0.0)).alias("avg_compliance_rate"),
        F.coalesce(F.sum("deviation"), F.lit(0)).alias("total_deviation"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing"),
    )


def field_compliance(facts: DataFrame, by_section: bool = False) -> DataFrame:
    """Per field over all patients.  The stay row shares its field with the stay
    standard and is merged with it unless ``by_section``."""
    keys = ["section", "field"] if by_section else ["field"]
    first = F.min(F.struct("item_pos", "label", "severity", "section", "category"))
    counted = facts.groupBy(*keys).agg(
        first.alias("f"),
        _count(COMPLIANT).alias("compliant"),
        _count(DEVIATION).alias("deviation"),
        _count(MISSING).alias("missing"),
        _count(NOT_ASSESSABLE).alias("not_assessable"),
        F.count(F.lit(1)).alias("total"),
    )
    return counted.select(
        "field",
        *[F.col(f"f.{c}").alias(c) for c in ("label", "severity", "section", "category")],
        "compliant",
        "deviation",
        "missing",
        "not_assessable",
        "total",
        rate(F.col("compliant"), F.col("compliant") + F.col("deviation") + F.col("missing")).alias("compliance_pct"),
    )


def mandatory_compliance(fields: DataFrame) -> DataFrame:
    return fields.filter(F.col("severity") == MANDATORY)


def low_compliance(fields: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return fields.filter(F.col("compliance_pct") < threshold).orderBy("compliance_pct", "field")


def stay_stats(summary: DataFrame, target: StayTarget, stay: str = "los_actual") -> DataFrame:
    s = F.col(stay)
    above = F.count_if(s > target.high) if target.high is not None else F.lit(0)
    below = F.count_if(s < target.low) if target.low is not None else F.lit(0)
    return summary.agg(
        F.count(s).alias("n"),
        F.avg(s).alias("mean"),
        F.percentile(s, F.lit(0.5)).alias("median"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        above.alias("above_target"),
        below.alias("below_target"),
        (F.count(s) - above - below).alias("within_target"),
    )
