"""A whole profile over a table of documents: long record, validated, coerced,
and pivoted at the edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..sources.profiles import Profile
from . import clinical as K, extract as E, records as Rec

LONG = ["patient_id", "field", "value"]
#: Parts a field's name from the position of its category while all share one scan.
TAG = "\x1f"


def extract_long(docs: DataFrame, profile: Profile, drugs: dict[str, list[str]] | None = None, order: str | None = None) -> DataFrame:
    """``(patient_id, field, value, rank)`` of every category.  Regex fields and nearly
    all built-ins share one scan of the documents and one aggregation.

    Of several categories with one field the later one that lists it has the greater
    ``rank``; fields that a category gives without listing them rank below all listed
    ones, the earlier category first."""
    shared, parts, keyword = [], [], []
    for at, c in enumerate(profile.categories):
        tag = f"{TAG}{at}"
        builtin = K.BUILTINS.get(c.builtin) if c.kind == "builtin" else None
        if c.kind == "regex" and c.regex:
            shared.append(K.tagged(K.regex_extractor(c.regex), tag))
        elif c.kind == "keyword":
            keyword += [E.KeywordRule(r.field + tag, r.keywords) for r in c.keywords]
        elif isinstance(builtin, K.Extractor):
            shared.append(K.tagged(builtin, tag))
        elif builtin:
            found = builtin(docs, drugs or {}) if c.builtin == "medications" else builtin(docs)
            parts.append(found.withColumn("field", F.concat("field", F.lit(tag))))
    if shared:
        parts.append(K.run_extractors(docs, shared))
    if keyword:
        parts.append(E.keyword_fields(docs, keyword, order=order))
    if not parts:
        none = F.lit(None).cast("string")
        return docs.select("patient_id", none.alias("field"), none.alias("value"), F.lit(0).alias("rank")).filter(F.lit(False))
    rows = reduce(lambda a, b: a.unionByName(b), [p.select(*LONG) for p in parts])
    at = F.split_part("field", F.lit(TAG), F.lit(2)).cast("int")
    named = Rec.with_aliases(rows.withColumns({"at": at, "field": F.split_part("field", F.lit(TAG), F.lit(1))}))
    listed = [f"{f}{TAG}{i}" for i, c in enumerate(profile.categories) for f in c.fields]
    is_listed = F.concat_ws(TAG, "field", "at").isin(*listed) if listed else F.lit(False)
    return named.select(*LONG, F.when(is_listed, F.col("at") + 1).otherwise(-1 - F.col("at")).alias("rank"))


def shares_fields(profile: Profile) -> bool:
    """Whether two categories may give one field.  Built-ins may give fields they do not list."""
    listed = [f for c in profile.categories for f in c.fields]
    return len(set(listed)) < len(listed) or sum(c.kind == "builtin" for c in profile.categories) > 0 and len(profile.categories) > 1


def run_profile(
    docs: DataFrame, profile: Profile, drugs: dict[str, list[str]] | None = None, order: str | None = None, wide: bool = False
) -> DataFrame:
    """Extract, turn sentinels to NULL, validate ranges, coerce types.  ``wide``
    gives one row per patient with the profile's fields as columns.  A field of
    several categories has the value of the later one (see `extract_long`)."""
    long = extract_long(docs, profile, drugs, order).withColumn("value", T.missing_to_null("value"))
    record = Rec.coerce(Rec.validate(long), profile.field_types)
    if not wide:
        if not shares_fields(profile):
            return record.drop("rank")
        rest = [c for c in record.columns if c not in ("patient_id", "field", "rank")]
        best = record.groupBy("patient_id", "field").agg(F.max_by(F.struct(*rest), "rank").alias("best"))
        return best.select("patient_id", "field", "best.*")
    patients = docs.select("patient_id").distinct()
    pivoted = Rec.to_wide(record, "patient_id", profile.fields)
    return patients.join(pivoted, "patient_id", "left")
