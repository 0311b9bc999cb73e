"""Declarative extraction: regex and keyword fields, terms, drugs.

Rules are compiled into expressions, so every document is read once; what
leaves a document is a small list of candidates.  Candidates are then reduced
per (patient, field) with ``min``, which combines on the map side - a patient
holding a third of all documents costs no more than any other."""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..rows import explode_rows, explode_structs
from ..session import MAX_RULE_ROWS, bounded_rows, materialise
from ..skew import neighbour_items

# Fixed values of the negation test and the drug windows.
NEGATION_WORDS = ["tidak", "tanpa", "negatif", "minus", "absen", "nihil", "kosong", "bukan", "belum", "non"]
POSITIVE_MARKERS = ["(+)", "positif", "ada", "terdapat", "ditemukan"]
NEGATION_WINDOW = 5
POSITIVE_WINDOW = 3
PRESENT, ABSENT = "ada", "tidak"
DOSE_TAIL, DURATION_TAIL = 80, 150
#: Letters of an n-gram under which a large dictionary is looked up.
GRAM = 4
DOSE_MAX, DURATION_MAX, JOINED_MAX, TERMS_SHOWN = 60, 50, 200, 10
DOSE_UNITS = r"(?:g|mg|mcg|gr|gram|mili?gram|mcg|ml|cc|IU|unit|mili?liter|mEq)"
DURATION_PATTERNS = [
    r"(?i)selama\s+(\d+\s*(?:hari|minggu|bulan|jam|dosis))",
    r"(?i)diberikan\s+(?:selama\s+)?(\d+\s*(?:hari|minggu|bulan))",
    r"(?i)(\d+\s*(?:hari|minggu|bulan))\s*(?:pemberian|terapi|diberikan|perawatan)?",
    r"(?i)lama\s*(?:terapi|pemberian|pengobatan)?\s*[:\s]+(\d+\s*(?:hari|minggu))",
]
ANY_TYPE_PRIORITY = 99


@dataclass(frozen=True)
class FieldRule:
    """One regex field: value is group 1 (a snippet) or 'ada' without a group."""

    field: str
    pattern: str
    doc_types: tuple[str, ...] = ()
    dotall: bool = False

    @property
    def java(self) -> str:
        return f"(?i{'s' if self.dotall else ''}d){self.pattern}"

    @property
    def has_group(self) -> bool:
        return re.search(r"(?<!\\)\((?!\?)", re.sub(r"\[[^\]]*\]", "", self.pattern)) is not None


@dataclass(frozen=True)
class KeywordRule:
    field: str
    keywords: tuple[str, ...] = dc_field(default_factory=tuple)


def type_priority(doc_type: Column, doc_types: tuple[str, ...]) -> Column:
    """Index in the rule's type list; NULL when the type is not allowed."""
    if not doc_types:
        return F.lit(ANY_TYPE_PRIORITY)
    pos = F.array_position(F.array(*[F.lit(d) for d in doc_types]), doc_type)
    return F.when(pos > 0, (pos - 1).cast("int"))


def candidate(name: str, prio: Column, pos: Column, order: Column, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("field"),
        prio.cast("int").alias("prio"),
        pos.cast("int").alias("pos"),
        order.alias("ord"),
        value.alias("value"),
    )


def best_candidates(docs: DataFrame, patient: str, found: list[Column]) -> DataFrame:
    """Explode the candidates of each document; best per (patient, field) by
    (priority, position, order)."""
    some = F.filter(F.array(*found), lambda c: c.isNotNull())
    rows = explode_structs(docs, [patient], some)
    return (
        rows.groupBy(patient, "field")
        .agg(F.min(F.struct("prio", "pos", "ord", "value")).alias("best"))
        .select(patient, "field", F.col("best.value").alias("value"))
    )


def regex_fields(
    docs: DataFrame, rules: list[FieldRule], patient: str = "patient_id", order: str = "source_file",
    doc_type: str = "doc_type", text: str = "text", max_len: int = 500,
) -> DataFrame:
    """Long ``(patient, field, value)`` of the regex rules; smaller index in the
    rule's type list wins, then file order; first match within a file."""
    t = F.col(text)
    found = []
    for r in rules:
        prio = type_priority(F.col(doc_type), r.doc_types)
        hit = F.regexp_extract(t, r.java, 1 if r.has_group else 0)
        value = F.nullif(T.clean_snippet(hit, max_len), F.lit("")) if r.has_group else F.lit(PRESENT)
        found.append(
            F.when(prio.isNotNull() & t.rlike(r.java), candidate(r.field, prio, F.lit(0), F.col(order), value))
        )
    best = best_candidates(docs, patient, found)
    return best.filter(F.col("value").isNotNull())


# ---------------------------------------------------------------------------
# Keyword fields with negation
# ---------------------------------------------------------------------------
def word_test(low: Column, keyword: str) -> Column:
    k = keyword.lower()
    return low.contains(k) & low.rlike(r"(?i)\b" + T.quote_regex(k) + r"\b")


def is_negated(before: Column, after: Column) -> Column:
    negatives = F.array(*[F.lit(w) for w in NEGATION_WORDS])
    return F.arrays_overlap(before, negatives) | F.arrays_overlap(after, negatives)


def is_affirmed(after: Column) -> Column:
    positives = F.array(*[F.lit(w) for w in POSITIVE_MARKERS])
    near = F.slice(after, 1, POSITIVE_WINDOW)
    return F.arrays_overlap(near, positives) | F.exists(near, lambda t: t.contains("(+)"))


def keyword_hits(
    docs: DataFrame, rules: list[KeywordRule], patient: str = "patient_id", order: str | None = "doc_seq", text: str = "text"
) -> DataFrame:
    """One row per (patient, field, keyword) of a document: was it found as a
    word, affirmed, negated.

    A token window may reach into neighbouring documents of the patient
    (``order`` is their integer order; None keeps windows inside documents).
    Only tokens near a document's edges and the hits travel through that step -
    the text itself is never shuffled."""
    n = NEGATION_WINDOW
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    words = sorted({k.lower() for r in rules for k in r.keywords})
    staged = docs.select(patient, *([order] if order else []), F.lower(text).alias("__low"), tokens.alias("__t"))
    size = F.size("__t")

    def hits_of(word: str) -> Column:
        at = F.filter(
            F.transform(F.col("__t"), lambda x, i: F.when(x.contains(word), i)), lambda i: i.isNotNull()
        )
        windows = F.transform(
            at,
            lambda i: F.struct(
                F.slice("__t", F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n))).alias("before"),
                F.slice("__t", i + 2, n).alias("after"),
            ),
        )
        plain = F.array().cast("array<struct<before:array<string>,after:array<string>>>")
        return F.when(
            F.col("__low").contains(word),
            F.struct(
                F.lit(word).alias("word"),
                word_test(F.col("__low"), word).alias("found"),
                (windows if " " not in word else plain).alias("windows"),
            ),
        )

    hits = F.filter(F.array(*[hits_of(w) for w in words]), lambda h: h.isNotNull())
    staged = staged.filter(size > 0).select(
        patient,
        *([order] if order else []),
        F.slice("__t", 1, n).alias("__head"),
        F.when(size > n, F.slice("__t", -n, n)).otherwise(F.col("__t")).alias("__tail"),
        hits.alias("__hits"),
    )
    if order:
        staged = neighbour_items(staged, [patient], order, "__head", "__tail", n)
        lead, follow = F.col("items_before"), F.col("items_after")
    else:
        lead = follow = F.array().cast("array<string>")
    rows = explode_rows(staged, [patient, lead.alias("__lead"), follow.alias("__follow")], "__hits", "h")

    def full_before(w: Column) -> Column:
        joined = F.concat(F.col("__lead"), w["before"])
        return F.when(F.size(w["before"]) >= n, w["before"]).otherwise(
            F.when(F.size(joined) > n, F.slice(joined, -n, n)).otherwise(joined)
        )

    def full_after(w: Column) -> Column:
        return F.slice(F.concat(w["after"], F.col("__follow")), 1, n)

    affirmed = F.exists("h.windows", lambda w: is_affirmed(full_after(w)))
    negated = F.exists("h.windows", lambda w: ~is_affirmed(full_after(w)) & is_negated(full_before(w), full_after(w)))
    return rows.select(
        patient, F.col("h.word").alias("word"), F.col("h.found").alias("found"), affirmed.alias("affirmed"), negated.alias("negated")
    )


def keyword_fields(docs: DataFrame, rules: list[KeywordRule], patient: str = "patient_id", order: str | None = "doc_seq", text: str = "text", strict: bool = False) -> DataFrame:
    """Long ``(patient, field, value)``: 'ada', 'tidak' or no row.

    A keyword is negated when one occurrence is negated and none is affirmed by
    an explicit marker; the field is present when any found keyword is not
    negated.  ``strict`` instead needs every occurrence negated."""
    hits = keyword_hits(docs, rules, patient, order, text)
    per_word = hits.groupBy(patient, "word").agg(
        F.bool_or("found").alias("found"),
        (F.bool_and("negated") if strict else F.bool_or("negated")).alias("negated"),
        F.bool_or("affirmed").alias("affirmed"),
    )
    fields = F.array(
        *[
            F.when(F.col("word").isin(*[k.lower() for k in r.keywords]), F.lit(r.field))
            for r in rules
            if r.keywords
        ]
    )
    positive = ~F.col("negated") | F.col("affirmed")
    return (
        per_word.filter("found")
        .select(patient, F.explode(F.array_compact(fields)).alias("field"), positive.alias("positive"))
        .groupBy(patient, "field")
        .agg(F.when(F.bool_or("positive"), F.lit(PRESENT)).otherwise(F.lit(ABSENT)).alias("value"))
    )


def generic_fields(docs: DataFrame, fields: list[str], keywords: list[str], patient: str = "patient_id", text: str = "text") -> DataFrame:
    """User-defined category: any keyword in any document sets all its fields to
    'ada', else 'tidak'; without keywords they stay 'unknown'."""
    low = F.lower(text)
    test = T.any_contains(low, [k.lower() for k in keywords]) if keywords else F.lit(False)
    hit = docs.groupBy(patient).agg(F.bool_or(test).alias("hit"))
    value = F.when(F.col("hit"), F.lit(PRESENT)).otherwise(F.lit(ABSENT)) if keywords else F.lit(T.UNKNOWN)
    return hit.select(patient, F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"), value.alias("value"))


# ---------------------------------------------------------------------------
# Terms and values with their sources
# ---------------------------------------------------------------------------
def term_presence(
    docs: DataFrame, terms: dict[str, list[str]], patient: str = "patient_id", order: str = "source_file",
    text: str = "text", radius: int = 120, max_len: int = 400, keep: int = 10,
) -> DataFrame:
    """Per field: 'yes' with the first source and evidence, and the first ``keep``
    candidates.  Each document offers its hits once; candidate lists are cut to
    ``keep`` per partial group by a row_number limit before the shuffle."""
    t, low = F.col(text), F.lower(text)
    hits = []
    for name, words in terms.items():
        for i, word in enumerate(words):
            at = F.instr(low, word.lower()) - 1
            hits.append(
                F.when(
                    low.contains(word.lower()),
                    F.struct(
                        F.lit(name).alias("field"),
                        F.col(order).alias("source"),
                        F.lit(i).alias("term_pos"),
                        F.lit(word).alias("keyword"),
                        T.char_context(t, at, at + len(word), radius, max_len).alias("evidence"),
                    ),
                )
            )
    from pyspark.sql import Window

    rows = explode_structs(docs, [patient], F.array_compact(F.array(*hits)))
    w = Window.partitionBy(patient, "field").orderBy("source", "term_pos")
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    return top.groupBy(patient, "field").agg(
        F.lit("yes").alias("value"),
        F.min_by("source", "rank").alias("source_file"),
        F.min_by("evidence", "rank").alias("evidence"),
        F.array_sort(F.collect_list(F.struct("rank", "keyword", "source", "evidence"))).alias("candidates"),
    )


def terms_with_source(
    docs: DataFrame, terms: list[str], preferred: list[str], patient: str = "patient_id", order: str = "source_file",
    doc_type: str = "doc_type", text: str = "text",
) -> DataFrame:
    """Word-bounded terms over a patient's documents, ordered-distinct, with the
    ordered-distinct types they came from (preferred types first)."""
    pref = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(doc_type))
    pref = F.when(pref > 0, pref).otherwise(F.lit(len(preferred) + 1)).cast("int")
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(text).rlike(r"(?i)\b" + T.quote_regex(x) + r"\b"),
                    F.struct(F.lit(i).alias("term_pos"), F.lit(x).alias("term")),
                )
                for i, x in enumerate(terms)
            ]
        )
    )
    rows = explode_rows(docs, [patient, pref.alias("pref"), F.col(order).alias("ord"), F.col(doc_type).alias("dt")], hits, "h")
    # first place of each term and each type: bounded by the lists themselves
    firsts = rows.groupBy(patient, "h.term", "dt").agg(F.min(F.struct("pref", "ord", "h.term_pos")).alias("at"))
    term_first = firsts.groupBy(patient, "term").agg(F.min("at").alias("at")).groupBy(patient).agg(
        F.array_sort(F.collect_list(F.struct("at", "term"))).alias("t")
    )
    type_first = firsts.groupBy(patient, "dt").agg(F.min("at").alias("at")).groupBy(patient).agg(
        F.array_sort(F.collect_list(F.struct("at", "dt"))).alias("s")
    )
    return term_first.join(type_first, patient).select(
        patient,
        F.array_join(F.col("t.term"), ", ").alias("terms"),
        F.array_join(F.col("s.dt"), ", ").alias("sources"),
    )


def value_with_source(
    docs: DataFrame, patterns: list[str], preferred: list[str], patient: str = "patient_id", order: str = "source_file",
    doc_type: str = "doc_type", text: str = "text",
) -> DataFrame:
    """First value over documents ordered by preferred type then file; within a
    document the first pattern that yields something."""
    t = F.col(text)
    values = []
    for p in patterns:
        rule = FieldRule("", p)
        hit = F.regexp_extract(t, f"(?imsd){p}", 1 if rule.has_group else 0)
        values.append(F.nullif(T.strip(F.regexp_replace(hit, "[ \t]+", " ")), F.lit("")))
    pref = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(doc_type))
    pref = F.when(pref > 0, pref).otherwise(F.lit(len(preferred) + 1)).cast("int")
    rows = docs.select(patient, pref.alias("pref"), F.col(order).alias("ord"), F.coalesce(*values).alias("value"), F.col(doc_type).alias("dt"))
    return (
        rows.filter(F.col("value").isNotNull())
        .groupBy(patient)
        .agg(F.min(F.struct("pref", "ord", "value", "dt")).alias("m"))
        .select(patient, F.col("m.value").alias("value"), F.col("m.dt").alias("source"))
    )


def all_matches(text: Column | str, pattern: str, limit: int | None = None) -> Column:
    """Every match of a document (or the first ``limit``) with position and hit."""
    spans = T.match_spans(text, pattern)
    return spans if limit is None else F.slice(spans, 1, limit)


MATCHES = "array<struct<label:string,nth:int,start:int,hit:string,context:string>>"


def labelled_matches(
    docs: DataFrame, rules: dict[str, str], keep: list[str], text: str = "text", radius: int = 100, limit: int | None = None, max_len: int = 450
) -> DataFrame:
    """One row per match of each labelled pattern: ``keep`` columns, ``label``, ``nth``
    (from 1, in text order), ``start`` (0-based), ``hit`` and the context of ``radius``
    characters on both sides.  ``limit`` keeps the first matches of a label in a document.

    Offsets come from the pieces between matches, inside the JVM; a text leaves its
    row only as contexts."""
    t = F.col(text)

    def of(label: str, pattern: str) -> Column:
        def row(m: Column, i: Column) -> Column:
            context = T.char_context(t, m["start"], m["start"] + F.length(m["hit"]), radius, max_len)
            return F.struct(F.lit(label).alias("label"), (i + 1).alias("nth"), m["start"].alias("start"), m["hit"].alias("hit"), context.alias("context"))

        return F.coalesce(F.when(t.rlike(pattern), F.transform(all_matches(t, pattern, limit), row)), F.array().cast(MATCHES))

    found = F.flatten(F.array(*[of(label, pattern) for label, pattern in rules.items()]))
    return explode_structs(docs, keep, found)


# ---------------------------------------------------------------------------
# Drugs
# ---------------------------------------------------------------------------
def _dose(context: Column, quoted: Column) -> Column:
    patterns = [
        F.concat(F.lit(r"(?i)(?:"), quoted, F.lit(r")[\s:,]*(\d+[.,]?\d*\s*" + DOSE_UNITS + r")(?:\s*(?:/|per)\s*(\d+)\s*(?:jam|hour|hari))?")),
        F.lit(r"(?i)(\d+\s*[x×]\s*\d+[.,]?\d*\s*(?:g|mg|mcg|gr|gram|ml))"),
        F.concat(F.lit(r"(?i)(?:"), quoted, F.lit(r")(?:.*?)(/\d+\s*(?:jam|hour))")),
    ]
    found = [F.trim(F.call_function("regexp_extract", context, p, F.lit(0))) for p in patterns]
    return F.coalesce(*[F.when((f != "") & (F.length(f) < DOSE_MAX), f) for f in found])


def _duration(context: Column) -> Column:
    found = [F.trim(F.regexp_extract(context, p, 0)) for p in DURATION_PATTERNS]
    return F.coalesce(*[F.when((f != "") & (F.length(f) < DURATION_MAX), f) for f in found])


def dose_near(tail: Column, term: str) -> Column:
    """Dose in the 80 characters after a drug's first mention, under 60 long."""
    return _dose(F.substring(tail, 1, len(term) + DOSE_TAIL), F.lit(T.quote_regex(term)))


def duration_near(tail: Column, term: str) -> Column:
    return _duration(F.substring(tail, 1, len(term) + DURATION_TAIL))


def drug_hits(docs: DataFrame, terms: DataFrame, patient: str, word_boundary: bool, with_windows: bool) -> DataFrame:
    """``patient, __ord, drug_key, term_pos, term, dose, duration`` of every term that a
    document holds, for a dictionary of any size (``drug_key, term_pos, term``).

    An inverted index of letter n-grams: each term is looked up by the n-gram of its
    own that fewest documents hold, documents meet terms on that n-gram, and only
    documents with such a term are read again to verify them.  Rows of the index are
    narrow; a text moves once, with its candidates beside it."""
    staged = docs.withColumn("__key", F.xxhash64("__low", patient, "__ord"))
    folded = terms.withColumn("low", F.col("term")).filter(F.length("low") > 0)
    size = F.least(F.length("low"), F.lit(GRAM))

    def grams(c: Column, n: int) -> Column:
        # one pass of the matcher over the text; a substring would count from its start for each place
        return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))

    kinds = [r["n"] for r in folded.select(size.alias("n")).distinct().collect()]  # GRAM rows at most
    if not kinds:
        kinds = [GRAM]
    posted = staged.select("__key", F.explode(F.flatten(F.array(*[F.coalesce(grams(F.col("__low"), n), F.array().cast("array<string>")) for n in kinds]))).alias("gram"))
    of_term = F.coalesce(*[F.when(size == n, grams(F.col("low"), n)) for n in kinds])
    asked = folded.select("drug_key", "term_pos", "term", F.explode(of_term).alias("gram"))
    wanted = asked.select("gram").distinct()
    held = posted.join(wanted, "gram", "left_semi")
    held = materialise(held)
    rare = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no document holds rules its term out
    priced = asked.join(rare, "gram", "left").groupBy("drug_key", "term_pos", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    chosen = priced.filter(F.col("best.n") > 0).select("drug_key", "term_pos", "term", F.col("best.gram").alias("gram"))
    pairs = held.join(chosen, "gram").groupBy("__key").agg(F.collect_set(F.struct("drug_key", "term_pos", "term")).alias("__terms"))
    both = staged.join(pairs, "__key")
    low, term = F.col("__low"), F.col("term")
    rows = both.select(patient, "__ord", "__low", F.explode(F.filter("__terms", lambda x: low.contains(x["term"]))).alias("__t")).select(patient, "__ord", "__low", "__t.*")
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    if word_boundary:
        rows = rows.filter(F.regexp_like(low, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b"))))
    tail = F.substring(low, F.instr(low, term), F.length(term) + DURATION_TAIL)
    none = F.lit(None).cast("string")
    dose = _dose(F.substring(tail, F.lit(1), F.length(term) + DOSE_TAIL), quoted) if with_windows else none
    duration = _duration(tail) if with_windows else none
    return rows.select(patient, "__ord", "drug_key", "term_pos", "term", dose.alias("dose"), duration.alias("duration"))


def _compiled_hits(staged: DataFrame, chosen: dict[str, list[str]], patient: str, word_boundary: bool, with_windows: bool) -> DataFrame:
    low, hits = F.col("__low"), []
    for key, terms in chosen.items():
        for i, term in enumerate(terms):
            test = low.contains(term)
            if word_boundary:
                test = test & low.rlike(r"\b" + T.quote_regex(term) + r"\b")
            tail = F.substring(low, F.instr(low, term), F.lit(len(term) + DURATION_TAIL))
            hits.append(
                F.when(
                    test,
                    F.struct(
                        F.lit(key).alias("drug_key"),
                        F.lit(i).alias("term_pos"),
                        F.lit(term).alias("term"),
                        (dose_near(tail, term) if with_windows else F.lit(None).cast("string")).alias("dose"),
                        (duration_near(tail, term) if with_windows else F.lit(None).cast("string")).alias("duration"),
                    ),
                )
            )
    return explode_structs(staged, [patient, "__ord"], F.array_compact(F.array(*hits)))


def medications(
    docs: DataFrame, drugs: dict[str, list[str]] | DataFrame, patient: str = "patient_id", order: str = "source_file",
    text: str = "text", selected: list[str] | None = None, word_boundary: bool = False, with_windows: bool = True,
    max_terms: int = MAX_RULE_ROWS,
) -> DataFrame:
    """Per patient and drug class: flag, first ten terms in dictionary order,
    doses and durations near each term's first mention.

    Up to ``max_terms`` terms are compiled into the plan; a larger dictionary is
    joined with the documents by letter n-grams (:func:`drug_hits`), with the same
    rows.  A document emits only the terms it holds."""
    if isinstance(drugs, dict):
        drugs = {k: v for k, v in drugs.items() if k.startswith("med_") and (selected is None or k in selected)}
        if not drugs:
            return docs.sparkSession.createDataFrame([], f"{patient} string, drug_key string, value string, detail string, dose string, duration string")
        compiled = drugs if sum(map(len, drugs.values())) <= max_terms else None
        table = None if compiled else docs.sparkSession.createDataFrame([(k, i, t) for k, v in drugs.items() for i, t in enumerate(v)], "drug_key string, term_pos int, term string")
        classes = list(drugs)
    else:
        kept = F.col("drug_key").startswith("med_") if selected is None else F.col("drug_key").isin(*selected)
        table, compiled = drugs.filter(kept), None
        known = bounded_rows(table.select("drug_key").distinct())
        if not known:
            raise ValueError(f"a dictionary needs 1 to {MAX_RULE_ROWS} classes")
        classes = sorted(r["drug_key"] for r in known)
    staged = docs.select(patient, F.col(order).alias("__ord"), F.lower(text).alias("__low"))
    rows = drug_hits(staged, table, patient, word_boundary, with_windows) if compiled is None else _compiled_hits(staged, compiled, patient, word_boundary, with_windows)
    first = rows.groupBy(patient, "drug_key", "term_pos", "term").agg(
        F.min(F.struct("__ord", "dose", "duration")).alias("m")
    )
    per_key = first.groupBy(patient, "drug_key").agg(
        F.array_sort(F.collect_list(F.struct("term_pos", "term", F.col("m.dose").alias("dose"), F.col("m.duration").alias("duration")))).alias("l")
    )

    def joined(name: str) -> Column:
        kept = F.array_distinct(F.filter(F.col(f"l.{name}"), lambda x: x.isNotNull()))
        return F.substring(F.array_join(kept, "; "), 1, JOINED_MAX)

    found = per_key.select(
        patient,
        "drug_key",
        F.lit(PRESENT).alias("value"),
        F.array_join(F.slice(F.array_distinct(F.col("l.term")), 1, TERMS_SHOWN), ", ").alias("detail"),
        joined("dose").alias("dose"),
        joined("duration").alias("duration"),
    )
    spine = docs.select(patient).distinct().select(patient, F.explode(F.array(*[F.lit(k) for k in classes])).alias("drug_key"))
    return spine.join(found, [patient, "drug_key"], "left").select(
        patient,
        "drug_key",
        F.coalesce("value", F.lit(ABSENT)).alias("value"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("detail", "dose", "duration")],
    )
