"""Document types: by file name, by content score, and what each may yield."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col

# Type names, order of tests, patterns and allow-lists.
NAME_TESTS = [
    ("resume", ["resume"]),
    ("radiology", ["rad"]),
    ("lab", ["lab"]),
    ("cppt_igd", ["cppt_igd"]),
    ("cppt_ranap", ["cppt_ranap", "ranap"]),
]
WIDE_NAME_TESTS = [
    ("resume", r"resume"),
    ("radiology", r"rad|radiologi|ct"),
    ("lab", r"lab|laboratorium"),
    ("cppt_igd", r"cppt_igd|cppt.*igd|igd.*cppt"),
    ("cppt_ranap", r"cppt_ranap|ranap|rawat_inap"),
]
DOC_PRIORITY = {"resume": 1, "radiology": 2, "lab": 3, "cppt_igd": 4, "cppt_ranap": 5, "other": 9}
ROLE_TESTS = [
    ("lab", r"^lab"),
    ("radiologi", r"^rad"),
    ("cppt_igd", r"cppt.*(igd|ugd|er\b)"),
    ("cppt_ranap", r"cppt.*(ranap|inap|rawat)"),
    ("resume", r"^(resume|ringkasan|discharge|lembar_resume)"),
    ("cppt_ranap", r"^cppt"),
]
CONTENT_CLASSES = {
    "CPPT IGD": [r"\bcppt\b.*\bigd\b", r"\bigd\b", r"instalasi gawat darurat", r"triase", r"asesmen awal.*igd"],
    "LAB": [r"laboratorium", r"\blab\b", r"hematologi", r"kimia klinik", r"\bhb\b", r"leukosit", r"trombosit", r"kreatinin", r"ureum"],
    "RAD": [r"radiologi", r"\brad\b", r"ct scan", r"msct", r"rontgen", r"imaging", r"kesan radiologi"],
    "RESUME": [r"resume medis", r"ringkasan pulang", r"discharge summary", r"resume pasien pulang", r"kondisi pulang"],
    "CPPT RANAP": [r"\bcppt\b", r"rawat inap", r"\branap\b", r"catatan perkembangan", r"soap"],
}
CONTENT_DEFAULT = "LAINNYA"
GROUPS_BY_TYPE = {
    "radiology": ["RADIOLOGY_CT", "DIAGNOSIS_STROKE"],
    "lab": ["LAB"],
    "resume": ["DIAGNOSIS_STROKE", "RADIOLOGY_CT", "LAB", "THERAPY_CP_AUDIT", "OUTCOME_LOS", "NEURO_EXAM"],
    "cppt_igd": ["ONSET_CHIEF_COMPLAINT", "NEURO_EXAM", "VITAL_SIGNS", "DIAGNOSIS_STROKE", "THERAPY_CP_AUDIT"],
    "cppt_ranap": ["THERAPY_CP_AUDIT", "OUTCOME_LOS", "NEURO_EXAM"],
}
TARGET_ROLES = {
    "klinis": ["cppt_ranap", "resume", "unknown"],
    "onset": ["cppt_igd", "unknown"],
    "staf": ["cppt_igd", "cppt_ranap", "resume", "unknown"],
    "lab": ["lab", "unknown"],
    "radio": ["radiologi", "unknown"],
}


def first_of(tests: list[tuple[Column, str]], default: str) -> Column:
    return reduce(lambda rest, t: F.when(t[0], F.lit(t[1])).otherwise(rest), reversed(tests), F.lit(default))


def doc_type_by_name(name: Column | str, tests=None, default: str = "other") -> Column:
    low = F.lower(col(name))
    tests = NAME_TESTS if tests is None else tests
    return first_of([(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), t) for t, words in tests], default)


def doc_type_by_name_wide(name: Column | str) -> Column:
    low = F.lower(col(name))
    return first_of([(low.rlike(p), t) for t, p in WIDE_NAME_TESTS], "other")


def file_role(stem: Column | str) -> Column:
    s = F.regexp_replace(F.lower(col(stem)), "_anonim$", "")
    return first_of([(s.rlike(p), t) for t, p in ROLE_TESTS], "unknown")


def doc_priority(doc_type: Column | str, priorities: dict[str, int] = DOC_PRIORITY, default: int = 9) -> Column:
    d = col(doc_type)
    return reduce(lambda rest, kv: F.when(d == kv[0], F.lit(kv[1])).otherwise(rest), priorities.items(), F.lit(default))


def content_scores(text: Column | str, classes: dict[str, list[str]] | None = None) -> Column:
    """STRUCT of the number of matching patterns per class."""
    t = F.lower(col(text))
    return F.struct(
        *[
            reduce(lambda a, b: a + b, [t.rlike("(?isd)" + p).cast("int") for p in patterns]).alias(name)
            for name, patterns in (classes or CONTENT_CLASSES).items()
        ]
    )


def class_by_content(text: Column | str, classes: dict[str, list[str]] | None = None, default: str = CONTENT_DEFAULT) -> Column:
    """Class with most matching patterns; ties keep the earlier class and no
    match gives the default."""
    classes = classes or CONTENT_CLASSES
    t = F.lower(col(text))
    ranked = [
        F.struct(
            reduce(lambda a, b: a + b, [t.rlike("(?isd)" + p).cast("int") for p in patterns]).alias("score"),
            F.lit(-i).alias("ord"),
            F.lit(name).alias("name"),
        )
        for i, (name, patterns) in enumerate(classes.items())
    ]
    best = F.array_max(F.array(*ranked))
    return F.when(best["score"] > 0, best["name"]).otherwise(F.lit(default))


def group_allowed(group: Column | str, doc_type: Column | str, table: dict[str, list[str]] | None = None) -> Column:
    """Which keyword groups may run on which type; unlisted types allow all."""
    g, d = col(group), col(doc_type)
    return reduce(
        lambda rest, kv: F.when(d == kv[0], g.isin(*kv[1])).otherwise(rest), (table or GROUPS_BY_TYPE).items(), F.lit(True)
    )


def routed(role: Column | str, target: str, wanted: bool = True) -> Column:
    """Whether an extractor runs: file role allows it and the user asked for it."""
    return col(role).isin(*TARGET_ROLES[target]) & F.lit(wanted)


def keep_long(df: DataFrame, text: str = "text") -> DataFrame:
    from ..functions.text import long_enough

    return df.filter(long_enough(text))
