"""Patient records: long form inside, wide form at the edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# Plausible ranges, sentinels, aliases.
RANGES = {
    "gcs": (3, 15, "GCS"),
    "td_sistol": (60, 260, "TD Sistol"),
    "td_diastol": (30, 180, "TD Diastol"),
    "hr": (30, 250, "HR/Nadi"),
    "rr": (5, 60, "RR"),
    "suhu": (35.0, 42.0, "Suhu"),
    "spo2": (50, 100, "SpO2"),
    "demo_age": (0, 120, "Usia"),
    "lab_hb": (2, 25, "HB"),
    "lab_leukosit": (0.1, 500, "Leukosit"),
    "lab_trombosit": (1, 1500, "Trombosit"),
    "lab_gds": (10, 800, "GDS"),
    "lab_ureum": (1, 300, "Ureum"),
    "lab_kreatinin": (0.1, 30, "Kreatinin"),
}
INVALID = "invalid"
FIELD_ALIASES = {"demo_age": "age", "demo_gender": "gender", "jenis_kelamin": "gender"}
CATEGORICAL = ["ada", "tidak", "tidak_ada", "invalid", "ada (+)"]
BP_LIMITS = ((60, 260), (30, 180))
GDS_LIMITS = (20, 800)
GCS_LIMITS = (3, 15)
REVIEW_STATES = ("AMAN", "PERLU_REVIEW", "ERROR")


def to_number(value: Column | str) -> Column:
    return F.replace(F.trim(T.col(value)), F.lit(","), F.lit(".")).try_cast("double")


def is_categorical(value: Column) -> Column:
    return value.isin(*CATEGORICAL) | value.startswith("ada")


def coerced_text(value: Column | str, field_type: Column | str) -> Column:
    """Value after type coercion, as text: numbers for ``numeric`` fields (whole
    ones without decimals), categorical values untouched, unparseable NULL."""
    v, kind = T.col(value), T.col(field_type)
    number = to_number(v)
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    shown = F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))
    return F.when(v == "", None).when(is_categorical(v) | (kind != "numeric") | kind.isNull(), v).otherwise(shown)


def coerce(record: DataFrame, types: dict[str, str], field: str = "field", value: str = "value") -> DataFrame:
    """Adds ``number DOUBLE``; ``value`` keeps the coerced text."""
    kind = F.element_at(_string_map(types), F.col(field)) if types else F.lit(None).cast("string")
    numeric = (kind == "numeric") & ~is_categorical(F.col(value))
    return record.withColumns(
        {value: coerced_text(F.col(value), kind), "number": F.when(numeric, to_number(F.col(value)))}
    )


def _string_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _range(field: Column, ranges: dict, i: int) -> Column:
    # a CASE over a dozen fields stays in codegen and needs no join
    return reduce(lambda rest, kv: F.when(field == kv[0], F.lit(kv[1][i])).otherwise(rest), reversed(ranges.items()), F.lit(None))


def validate(record: DataFrame, ranges: dict | None = None, field: str = "field", value: str = "value") -> DataFrame:
    """Out-of-range numbers become 'invalid' with a warning; what is not a number
    is kept.  Runs before coercion."""
    ranges = RANGES if ranges is None else ranges
    f, v = F.col(field), F.col(value)
    number = F.replace(v, F.lit(","), F.lit(".")).try_cast("double")
    low = _range(f, {k: (float(x[0]), 0) for k, x in ranges.items()}, 0)
    high = _range(f, {k: (float(x[1]), 0) for k, x in ranges.items()}, 0)
    label = _range(f, {k: (x[2],) for k, x in ranges.items()}, 0)
    text = _range(f, {k: (f"{x[0]}-{x[1]}",) for k, x in ranges.items()}, 0)
    bad = number.isNotNull() & low.isNotNull() & ((number < low) | (number > high))
    warning = F.concat(label, F.lit("="), v, F.lit(" (range: "), text, F.lit(")"))
    return record.withColumns(
        {value: F.when(bad, F.lit(INVALID)).otherwise(v), "warning": F.when(bad, warning)}
    )


def with_aliases(record: DataFrame, aliases: dict[str, str] | None = None, field: str = "field") -> DataFrame:
    """Copies of a source field under each of its aliases; the source is kept."""
    aliases = FIELD_ALIASES if aliases is None else aliases
    by_source: dict[str, list[str]] = {}
    for name, source in aliases.items():
        by_source.setdefault(source, []).append(name)
    f = F.col(field)
    names = reduce(
        lambda rest, kv: F.when(f == kv[0], F.array(f, *[F.lit(n) for n in kv[1]])).otherwise(rest),
        by_source.items(),
        F.array(f),
    )
    return record.withColumn(field, F.explode(names))


def prefixed(record: DataFrame, prefixes: dict[str, str], category: str = "category", field: str = "field") -> DataFrame:
    prefix = F.coalesce(F.element_at(_string_map(prefixes), F.col(category)), F.lit(""))
    return record.withColumn(field, F.concat(prefix, F.col(field)))


def select_rules(rules: list, fields: list[str] | None):
    """None selects all, an empty list none."""
    return list(rules) if fields is None else [r for r in rules if r.field in fields]


def to_wide(record: DataFrame, patient: str, fields: list[str], value: str = "value", field: str = "field", rank: str = "rank") -> DataFrame:
    """Pivot with an explicit field list: the schema never depends on the data.
    Of several values of one field the one of the greatest ``rank`` stands where the
    record has such a column, else the greatest value, in every run."""
    best = F.max_by(value, rank) if rank in record.columns else F.max(value)
    return record.groupBy(patient).pivot(field, fields).agg(best)


def to_long(wide: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return wide.unpivot(keys, [F.col(f) for f in fields], "field", "value")


def review_status(error: Column | str, needs_review: Column | str) -> Column:
    safe, review, failed = REVIEW_STATES
    return F.when(T.col(error), failed).when(T.col(needs_review), review).otherwise(safe)


def check_blood_pressure(raw: Column | str) -> Column:
    """'sys/dia mmHg' within limits, '' outside, raw text when no pair is found."""
    r = T.col(raw)
    sys_, dia = (F.regexp_extract(r, r"(\d{2,3})\s*/\s*(\d{2,3})", i).try_cast("int") for i in (1, 2))
    ok = sys_.between(*BP_LIMITS[0]) & dia.between(*BP_LIMITS[1])
    return F.when(sys_.isNull(), r).when(ok, F.format_string("%d/%d mmHg", sys_, dia)).otherwise("")


def check_glucose(raw: Column | str) -> Column:
    r = T.col(raw)
    n = F.regexp_extract(r, r"(\d{2,4})", 1).try_cast("int")
    return F.when(n.isNull() | n.between(*GDS_LIMITS), r).otherwise("")


def check_gcs(raw: Column | str) -> Column:
    """Total 3-15, else the sum of E/V/M digits 3-15, else ''."""
    r = T.col(raw)
    total = F.regexp_extract(r, r"(\d{1,2})", 1).try_cast("int")
    parts = F.regexp_extract_all(r, F.lit(r"(?i)[EVM](\d)"), F.lit(1))
    summed = F.aggregate(parts, F.lit(0), lambda a, x: a + x.cast("int"))
    ok = total.between(*GCS_LIMITS) | ((F.size(parts) > 0) & summed.between(*GCS_LIMITS))
    return F.when(total.isNull(), r).when(ok, r).otherwise("")


def stay_days(admitted: Column | str, discharged: Column | str) -> Column:
    """Whole days when the discharge is not before the admission."""
    a, d = T.parse_day_first_date(admitted), T.parse_day_first_date(discharged)
    return F.when(d >= a, F.datediff(d, a))


def error_rows(requested: DataFrame, docs: DataFrame, patient: str = "patient_id", text: str = "text") -> DataFrame:
    """Requested patients without any document, or without a usable one."""
    have = docs.groupBy(patient).agg(F.bool_or(T.long_enough(text)).alias("usable"))
    return (
        requested.select(patient).distinct().join(have, patient, "left")
        .filter(F.coalesce(~F.col("usable"), F.lit(True)))
        .select(patient, F.when(F.col("usable").isNull(), "folder_not_found").otherwise("no_valid_files").alias("error"))
    )


def inventory(docs: DataFrame, keys: list[str], doc_type: str = "doc_type", text: str = "text") -> DataFrame:
    n = F.length(text)
    return docs.select(
        *keys, doc_type, n.alias("char_count"),
        F.when(T.nonspace_length(text) < T.MIN_SOURCE_CHARS, "Perlu OCR manual").otherwise("Terbaca").alias("status"),
    )
