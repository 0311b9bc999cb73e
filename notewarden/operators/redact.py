"""Counted, ordered redaction of documents.

Every step is one projection (no shuffle): the number of hits of a rule and the
text after it.  A rule only runs on texts that hold one of its needles, and the
replacement only on texts with hits."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules as R
from ..functions import text as T
from ..rules import Rule
from ..session import MAX_RULE_ROWS, materialise
from . import names
from .untouched import lines_above, parted, touched

COUNTS_TYPE = "map<string,int>"
#: Texts that go through the chain and its joins: parts for each core, and rows of a part.
PARTS_PER_CORE, ROWS_PER_PART = 4, 5_000


def empty_counts() -> Column:
    return F.create_map().cast(COUNTS_TYPE)


def has_needle(text: Column, rule: Rule, low: Column | None = None) -> Column | None:
    """Necessary condition for a hit: one of the needles, then the gate."""
    tests = []
    if rule.needles:
        tests.append(T.any_contains(F.lower(text), rule.needles) if low is None else T.any_contains(low, rule.needles, singly=12))
    if rule.gate:
        tests.append(text.rlike("(?id)" + rule.gate))
    return reduce(lambda a, b: a & b, tests) if tests else None


def hit_count(text: Column | str, rule: Rule) -> Column:
    t = T.col(text)
    hits = F.regexp_count(t, F.lit(rule.java))
    needle = has_needle(t, rule)
    return hits if needle is None else F.when(needle, hits).otherwise(F.lit(0))


def hit_list(text: Column | str, rule: Rule) -> Column:
    t = T.col(text)
    hits = F.regexp_extract_all(t, F.lit(rule.java), F.lit(0))
    needle = has_needle(t, rule)
    return hits if needle is None else F.when(needle, hits).otherwise(F.array().cast("array<string>"))


def histogram(keys: Column) -> Column:
    """MAP of key -> number of occurrences in an ARRAY<STRING>."""
    distinct = F.array_distinct(keys)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.size(F.filter(keys, lambda x: x == k))))


def merge_counts(a: Column | str, b: Column | str) -> Column:
    """Key-wise sum of two count maps."""
    zero = F.lit(0)
    return F.map_zip_with(
        T.col(a), T.col(b), lambda _, x, y: (F.coalesce(x, zero) + F.coalesce(y, zero)).cast("int")
    )


class _Chain:
    """Collects the counters of a run of steps and folds them into one map."""

    def __init__(self, df: DataFrame, text: str, active: str | None = None):
        self.df, self.text, self.active = df, text, active
        self.counters: list[tuple[str, str]] = []
        self.keyed = False
        #: columns that tell whether the text changed after ``__low`` was taken from it
        self.changes: list[str] | None = None
        self.relabelled: list[str] = []

    def _guard(self, condition: Column | None) -> Column | None:
        parts = [c for c in (F.col(self.active) if self.active else None, condition) if c is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _lowered(self) -> Column:
        """The text in lower case, taken again only in rows that a rule has changed."""
        low = F.lower(F.col(self.text))
        if self.changes is None:
            return low if self.active is None else F.when(F.col(self.active), low)
        if not self.changes:
            return F.col("__low")
        return F.when(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in self.changes]), low).otherwise(F.col("__low"))

    def _test(self, rule: Rule) -> tuple[Column | None, dict[str, Column]]:
        """The rule's guard, and the column of lower-cased text it needs."""
        if not rule.needles:
            return self._guard(has_needle(F.col(self.text), rule)), {}
        low = self._lowered()
        self.changes = []
        return self._guard(has_needle(F.col(self.text), rule, low)), {"__low": low}

    def _changed(self, name: str) -> None:
        if self.changes is not None:
            self.changes.append(name)

    def rule(self, rule: Rule) -> None:
        name = f"__n{len(self.counters)}"
        t = F.col(self.text)
        hits = F.regexp_count(t, F.lit(rule.java))
        guard, lowered = self._test(rule)
        n = hits if guard is None else F.when(guard, hits).otherwise(F.lit(0))
        # one projection per rule; the count and the lower-cased text are common subexpressions
        self.df = self.df.withColumns(
            {**lowered, name: n, self.text: F.when(n > 0, F.regexp_replace(t, rule.java, rule.replacement)).otherwise(t)}
        )
        self.counters.append((rule.key, name))
        self._changed(name)

    def labelled(self, rule: Rule, described: Column) -> None:
        """Replacement and counter key computed per match: ``described`` maps the
        column ``__hits`` to ARRAY<STRUCT<label,key>>; a NULL key is not counted.

        Exact per position: the pieces between matches are interleaved with the
        labels, so equal strings outside a match are left alone."""
        t = F.col(self.text)
        none = F.array().cast("array<struct<label:string,key:string>>")
        hits = F.regexp_extract_all(t, F.lit(rule.java), F.lit(0))
        guard, lowered = self._test(rule)
        if guard is not None:
            hits = F.when(guard, hits).otherwise(F.array().cast("array<string>"))
        keys = F.col("__keys") if self.keyed else F.array().cast("array<string>")
        some = F.size("__hits") > 0
        interleaved = F.array_join(
            F.zip_with(
                F.split(t, rule.java, -1), F.col("__marks"), lambda piece, m: F.concat(piece, F.coalesce(m["label"], F.lit("")))
            ),
            "",
        )
        counted = F.filter(F.col("__marks.key"), lambda k: k.isNotNull())
        self.df = self.df.withColumns({**lowered, "__hits": hits})
        self.df = self.df.withColumn("__marks", F.when(some, described).otherwise(none))
        changed = f"__changed{len(self.relabelled)}"
        self.df = self.df.withColumns(
            {
                "__keys": F.when(some, F.concat(keys, counted)).otherwise(keys),
                self.text: F.when(some, interleaved).otherwise(t),
                changed: F.size("__hits"),
            }
        )
        self.keyed = True
        self.relabelled.append(changed)
        self._changed(changed)

    def rewrite(self, value: Column) -> None:
        """A change of the text that is not counted."""
        self.df = self.df.withColumn(self.text, value if self.active is None else F.when(F.col(self.active), value).otherwise(F.col(self.text)))
        self.changes = None

    def finish(self, counts: str) -> DataFrame:
        columns = self.df.columns
        merged = F.col(counts) if counts in columns else empty_counts()
        drop = {n for _, n in self.counters} | {"__hits", "__marks", "__keys", "__low", *self.relabelled, counts}
        if self.counters:
            by_key: dict[str, Column] = {}
            for key, name in self.counters:
                by_key[key] = by_key[key] + F.col(name) if key in by_key else F.col(name)
            pairs = [x for k, v in by_key.items() for x in (F.lit(k), v.cast("int"))]
            fixed = F.map_filter(F.create_map(*pairs), lambda _, v: v > 0)
            total = reduce(lambda a, b: a + b, [F.col(n) for _, n in self.counters])
            merged = F.when(total > 0, merge_counts(merged, fixed)).otherwise(merged)
        if self.keyed:
            merged = F.when(F.size("__keys") > 0, merge_counts(merged, histogram(F.col("__keys")))).otherwise(merged)
        return self.df.select(*[c for c in columns if c not in drop], merged.alias(counts))


def apply_rules(
    df: DataFrame, rules: Iterable[Rule], text: str = "text", counts: str = "counts", active: str | None = None
) -> DataFrame:
    """Ordered replace-and-count chain; each rule sees its predecessor's text."""
    chain = _Chain(df, text, active)
    for rule in rules:
        chain.rule(rule)
    return chain.finish(counts)


def literal_rules(items: Iterable[str], label: str, key: str, min_chars: int = 1) -> list[Rule]:
    """Case-insensitive literal list, one rule per item in the given order."""
    cleaned = [i.strip() for i in items]
    return [
        Rule(key, T.quote_regex(i), label, needles=(i.lower(),)) for i in cleaned if len(i) >= max(min_chars, 1)
    ]


def label_rules_keep_field(fields: dict[str, tuple[str, str]]) -> list[Rule]:
    """Keep the field's name and mask only its value: ``Name: [LABEL]``."""
    return [Rule(key, pattern, f"$1: [{label}]") for key, (pattern, label) in fields.items()]


# ---------------------------------------------------------------------------
# Stages of the full pipeline.  A stage is (chain) -> None, so that the list of
# stages - the chain's shape - is plain data.  ``rules`` names all that it can
# match; a stage without it is taken to change any text.
# ---------------------------------------------------------------------------
Stage = Callable[[_Chain], None]


def staged(rules: Iterable[Rule]) -> Callable[[Stage], Stage]:
    def mark(stage: Stage) -> Stage:
        stage.rules = list(rules)
        return stage

    return mark


def rules_of(stages: list[Stage]) -> list[Rule] | None:
    if not all(hasattr(s, "rules") for s in stages):
        return None
    return [r for s in stages for r in s.rules]


def rules_stage(rules: Iterable[Rule]) -> Stage:
    fixed = list(rules)

    @staged(fixed)
    def run(chain: _Chain) -> None:
        for rule in fixed:
            chain.rule(rule)

    return run


@staged(R.DOCTOR_RULES)
def doctor_stage(chain: _Chain) -> None:
    def describe(hit: Column) -> Column:
        # one-element arrays name the role and the kept prefix inside the lambda
        marks = F.transform(
            F.array(F.struct(names.role_of(hit).alias("role"), F.regexp_extract(hit, R.DOCTOR_PREFIX, 1).alias("prefix"))),
            lambda x: F.struct(
                F.concat(
                    F.when(x["prefix"] != "", F.concat(x["prefix"], F.lit(": "))).otherwise(F.lit("")),
                    F.lit("["), x["role"], F.lit("]"),
                ).alias("label"),
                F.concat(F.lit("doctor_regex_"), x["role"]).alias("key"),
            ),
        )
        return F.element_at(marks, 1)

    described = F.transform(F.col("__hits"), describe)
    for rule in R.DOCTOR_RULES:
        chain.labelled(rule, described)


def _header_role(joined: Column) -> Column:
    chosen = F.lit("PPA")
    for name, pattern in reversed(R.NOTE_HEADER_ROLES):
        chosen = F.when(joined.rlike(pattern), F.lit(name) if name else names.role_of(joined)).otherwise(chosen)
    return chosen


@staged([R.NOTE_HEADER])
def note_header_stage(chain: _Chain) -> None:
    java = R.NOTE_HEADER.java

    def describe(hit: Column) -> Column:
        block = F.regexp_extract(hit, java, 2)
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        parts = F.struct(F.array_join(lines, " ").alias("joined"), F.size(lines).alias("n"))
        roles = F.transform(
            F.array(parts),
            lambda p: F.when(
                ~T.any_contains(F.lower(p["joined"]), R.CLINICAL_STOPWORDS)
                & (p["n"] <= R.NOTE_HEADER_MAX_LINES)
                & (F.length(p["joined"]) <= R.NOTE_HEADER_MAX_CHARS),
                _header_role(p["joined"]),
            ),
        )
        marks = F.transform(
            roles,
            lambda role: F.struct(
                F.coalesce(
                    F.concat(F.regexp_extract(hit, java, 1), F.lit("["), role, F.lit("]\n"), F.regexp_extract(hit, java, 3)),
                    hit,
                ).alias("label"),
                F.concat(F.lit("cppt_header_"), role).alias("key"),
            ),
        )
        return F.element_at(marks, 1)

    chain.labelled(R.NOTE_HEADER, F.transform(F.col("__hits"), describe))


SPACE_AT_LINE_END = Rule("", "[ \t]+\n", "\n", "")


@staged([*R.CLEANUP_RULES, SPACE_AT_LINE_END])
def cleanup_stage(chain: _Chain) -> None:
    for rule in R.CLEANUP_RULES:
        chain.rule(rule)
    chain.rewrite(F.regexp_replace(F.col(chain.text), SPACE_AT_LINE_END.pattern, SPACE_AT_LINE_END.replacement))


@staged(R.SPLIT_LINE_RULES)
def split_line_stage(chain: _Chain) -> None:
    """Doctor names on one line with the degree on the next."""
    described = F.transform(
        F.col("__hits"),
        lambda h: F.element_at(
            F.transform(F.array(names.role_of(h)), lambda role: F.struct(F.concat(F.lit("["), role, F.lit("]")).alias("label"), role.alias("key"))), 1
        ),
    )
    for rule in R.SPLIT_LINE_RULES:
        chain.labelled(rule, described)


def harvest_names(df: DataFrame, text: str = "text", name: str = "candidates", known: list[str] | None = None) -> DataFrame:
    """Distinct name candidates of each document, longest first."""
    t = F.col(text)
    found = [F.regexp_extract_all(t, F.lit("(?id)" + p), F.lit(1)) for p in R.HARVEST_PATTERNS]
    raw = F.flatten(F.array(*found, F.array(*[F.lit(k) for k in known or []]).cast("array<string>")))
    trimmed = F.transform(raw, lambda n: F.regexp_replace(n, r"^[ ,.\-]+|[ ,.\-]+$", ""))
    kept = F.array_except(F.filter(trimmed, lambda n: F.length(n) >= 2), F.array(*[F.lit(n) for n in R.NEVER_NAMES]))
    return df.withColumn(
        name,
        F.array_sort(
            kept,
            lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)),
        ),
    )


def replace_harvested(df: DataFrame, text: str = "text", candidates: str = "candidates", label: str = "[NAMA]") -> DataFrame:
    """Replace a document's own candidates everywhere in it, longest first."""
    walked = F.aggregate(
        F.col(candidates),
        F.col(text),
        lambda acc, n: F.regexp_replace(
            acc, F.concat(F.lit(r"(?i)\b"), F.regexp_replace(n, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1"), F.lit(r"\b")), F.lit(label)
        ),
    )
    return df.withColumn(text, F.when(F.size(candidates) > 0, walked).otherwise(F.col(text)))


def facility_rules(facilities: list[str]) -> list[Rule]:
    """Facility names with flexible separators, then the generic patterns."""
    named = [
        Rule("RUMAH_SAKIT_ALAMAT_RS", r"(?<![A-Za-z])" + names.variant_pattern(f) + r"(?![A-Za-z])", "[RUMAH_SAKIT]", needles=(f.split()[0].lower(),))
        for f in facilities
        if f.strip()
    ]
    return named + R.FACILITY_GENERIC_RULES


def run_stages(
    df: DataFrame, stages: list[Stage], text: str = "text", counts: str = "counts", active: str | None = None
) -> DataFrame:
    chain = _Chain(df, text, active)
    for stage in stages:
        stage(chain)
    return chain.finish(counts)


def full_stages(staff_rules: list[Rule]) -> list[Stage]:
    return [
        rules_stage(R.IDENTITY_RULES),
        rules_stage(staff_rules),
        doctor_stage,
        rules_stage(R.STAFF_RULES),
        note_header_stage,
        cleanup_stage,
    ]


def light_stages(exact_names: list[Rule]) -> list[Stage]:
    """Shape for long texts: every identity rule, dashed record numbers, then line
    patterns in place of the name and header scans, with clean-up on both sides."""
    return [
        rules_stage(R.IDENTITY_RULES),
        rules_stage(R.DASHED_NUMBER_RULES),
        rules_stage(R.ADMIN_LINE_RULES),
        rules_stage(exact_names),
        rules_stage(R.LIGHT_STAFF_RULES),
        rules_stage([Rule("DOUBLE_LABEL", r"(\[[A-Z_]+\])(?:\s*,?\s*\1)+", "$1", "i", ("[",))]),
        rules_stage(R.ADMIN_LINE_RULES),
    ]


def redact(
    df: DataFrame, staff: list[Rule] | DataFrame = (), passes: int = 2, text: str = "text", counts: str = "counts", key: str | None = None, max_rows: int = MAX_RULE_ROWS
) -> DataFrame:
    """Normalise, run the six stages ``passes`` times, scan for leftovers.

    ``staff`` is a table of name variants of any size (``variant, role``), or rules
    compiled from one.  Up to ``max_rows`` variants are compiled; more are joined
    on word pairs by the documents' ``key``, with the same result.  A later pass can
    only differ from the one before where that one changed the text, so unchanged
    texts skip it."""
    if staff is None:
        raise ValueError("staff is None: give the table of variants, so that a large dictionary is joined")
    variants = staff if isinstance(staff, DataFrame) else None
    rules = list(staff) if variants is None else names.compile_staff(variants, max_rows)
    if rules is None and key is None:
        raise ValueError("a dictionary of more than max_rows variants needs the documents' key")
    stages = full_stages(rules or [])
    fixed = rules_of([*stages[:1], *stages[2:]]) + R.LEFTOVER_RULES
    out = df.withColumn(text, T.normalize(text))
    if rules is None:
        return _redact_joined(out, variants, stages, fixed, passes, text, counts, key)
    t, open_ = F.col(text), F.col("__open")
    named = [has_needle(t, r) & t.rlike(r.java) if r.needles else t.rlike(r.java) for r in rules]
    out = out.withColumn("__open", reduce(lambda a, b: a | b, named, touched(t, fixed)))
    out = out.withColumns({"__kept": F.when(~open_, t), text: F.when(open_, t).when(t.isNotNull(), "")}).drop("__open")
    for number in range(passes):
        out = _pass(out, number, passes, text, lambda d, active: run_stages(d, stages, text, counts, active))
    return scan_leftovers(out, text=text).withColumn(text, F.coalesce("__kept", text)).drop("__kept")


def _pass(df: DataFrame, number: int, passes: int, text: str, run: Callable[[DataFrame, str | None], DataFrame]) -> DataFrame:
    """One pass; from the second on over texts that the one before has changed."""
    before, active, out = f"__before{number}", f"__active{number}" if number else None, df
    if active:
        previous = f"__before{number - 1}"
        out = out.withColumn(active, F.col(text) != F.col(previous)).drop(previous)
    if number + 1 < passes:
        out = out.withColumn(before, F.col(text))
    out = run(out, active)
    return out.drop(active) if active else out


def _redact_joined(
    df: DataFrame, variants: DataFrame, stages: list[Stage], fixed: list[Rule], passes: int, text: str, counts: str, key: str
) -> DataFrame:
    """Texts that hold neither a pair of words with which a name begins nor a place where
    a rule may match are left as they are; only the others go through the chain and its
    joins.  What a join reads twice is stored first."""
    index = materialise(names.name_index(variants))
    hashes = names.pair_hashes(index)
    named = F.lit(True) if hashes is None else names.may_hold_name(F.col(text), hashes)
    flagged = df.withColumn("__open", touched(F.col(text), fixed) | named)
    out = materialise(flagged.filter("__open").drop("__open"))
    parts = max(PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-out.count() // ROWS_PER_PART))
    out = out.repartition(parts, key)

    def run(d: DataFrame, active: str | None) -> DataFrame:
        d = materialise(run_stages(d, stages[:1], text, counts, active))
        d = names.redact_staff_join(d, variants, key, text, counts, index, hashes, active)
        # the parts of the join are even by bytes, but few
        return run_stages(d.repartition(parts, key), stages[2:], text, counts, active)

    for number in range(passes):
        out = _pass(out, number, passes, text, run)
        if number + 1 < passes:
            out = materialise(out)
    idle = flagged.filter("not __open").drop("__open")
    if counts not in df.columns:
        idle = idle.withColumn(counts, empty_counts())
    empty = {"leftovers": empty_counts(), "leftover_examples": F.create_map().cast("map<string,array<string>>"), "needs_manual_review": F.lit(False)}
    return scan_leftovers(out, text=text).unionByName(idle.withColumns(empty))


def route_by_length(
    df: DataFrame, short: list[Stage], long: list[Stage], limit: int = R.LONG_DOCUMENT_CHARS, text: str = "text", counts: str = "counts"
) -> DataFrame:
    """Long texts take the lighter stages, the others the full ones.  Both chains
    run over the same scan; each touches only the rows of its route, and of these
    only the text from a few lines above the first place where a rule may match."""
    size = F.coalesce(F.length(text), F.lit(0))
    out = df.withColumns({"__short": size <= limit, "__long": size > limit})
    rules = [rules_of(short), rules_of(long)]
    trimmed = None not in rules and any(rules)
    if trimmed:
        lines = F.when(F.col("__short"), lines_above(rules[0])).otherwise(lines_above(rules[1]))
        out = out.withColumn("__parts", parted(F.col(text), rules[0] + rules[1], lines))
        out = out.withColumns({"__above": F.col("__parts.above"), text: F.col("__parts.rest")}).drop("__parts")
    out = run_stages(run_stages(out, short, text, counts, "__short"), long, text, counts, "__long")
    if trimmed:
        out = out.withColumn(text, F.concat("__above", text)).drop("__above")
    return out.withColumn("route", F.when(F.col("__long"), "long").otherwise("short")).drop("__short", "__long")


def mask_page_edges(df: DataFrame, text: str = "text", counts: str = "counts", label: str = "[HEADER_FOOTER_RS]") -> DataFrame:
    """Facility lines among the first and last eight lines are replaced
    wherever they occur in the document."""
    lines = F.split(F.col(text), "\n")
    edge = F.array_distinct(
        F.concat(F.slice(lines, 1, R.EDGE_LINES), F.slice(lines, -F.least(F.size(lines), F.lit(R.EDGE_LINES)), F.lit(R.EDGE_LINES)))
    )
    found = F.array_sort(
        F.filter(edge, lambda x: x.rlike(R.FACILITY_WORDS)),
        lambda a, b: F.length(b) - F.length(a),
    )
    walked = F.aggregate(
        found,
        F.struct(F.col(text).alias("t"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.replace(acc["t"], x, F.lit(label)).alias("t"),
            (acc["n"] + ((F.length(acc["t"]) - F.length(F.replace(acc["t"], x, F.lit("")))) / F.length(x)).cast("int")).alias("n"),
        ),
    )
    out = df.withColumn("__edge", F.when(F.col(text).rlike(R.FACILITY_WORDS), walked))
    n = F.coalesce(F.col("__edge.n"), F.lit(0))
    base = F.col(counts) if counts in df.columns else empty_counts()
    return out.withColumns(
        {
            text: F.coalesce(F.col("__edge.t"), F.col(text)),
            counts: F.when(n > 0, merge_counts(base, F.create_map(F.lit("header_footer_rs"), n))).otherwise(base),
        }
    ).drop("__edge")


def mask_identity(df: DataFrame, text: str = "text", counts: str = "counts") -> DataFrame:
    """The alternative redactor: eleven masks, then page headers and footers."""
    return mask_page_edges(apply_rules(df, R.MASK_RULES, text, counts), text, counts)


# ---------------------------------------------------------------------------
# Leftovers
# ---------------------------------------------------------------------------
def _excused_hits(text: Column, rule: Rule) -> Column:
    """Hits that have no doctor label within the 80 characters before them."""
    spans = T.match_spans(text, rule.java)
    kept = F.filter(
        spans,
        lambda s: ~F.substring(
            text, F.greatest(s["start"] - R.EXCUSE_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(R.EXCUSE_CHARS))
        ).rlike("(?i)" + R.EXCUSE_LABEL),
    )
    hits = F.transform(kept, lambda s: s["hit"])
    return F.when(has_needle(text, rule) & text.rlike(rule.java), hits).otherwise(F.array().cast("array<string>"))


def hashed(hits: Column, keep: int = 3) -> Column:
    """First ``keep`` hits as 16 hex digits of SHA-256 - evidence without text."""
    return F.transform(
        F.slice(hits, 1, keep),
        lambda h: F.substring(F.sha2(F.replace(F.trim(h), F.lit("\n"), F.lit(" ")), 256), 1, 16),
    )


def scan_leftovers(
    df: DataFrame, rules: list[Rule] | None = None, text: str = "text", prefix: str = "leftover"
) -> DataFrame:
    """Adds ``<prefix>s MAP<STRING,INT>``, ``<prefix>_examples`` and
    ``needs_manual_review``; only patterns with hits are kept in the maps."""
    rules = R.LEFTOVER_RULES if rules is None else rules
    t = F.col(text)
    entries = [
        F.struct(F.lit(r.key).alias("key"), (_excused_hits(t, r) if r.key == R.EXCUSED_LEFTOVER else hit_list(t, r)).alias("hits"))
        for r in rules
    ]
    out = df.withColumn("__hits", F.array(*entries)).withColumn(
        "__hits", F.filter("__hits", lambda e: F.size(e["hits"]) > 0)
    )
    keys = F.transform("__hits", lambda e: e["key"])
    return out.withColumns(
        {
            f"{prefix}s": F.map_from_arrays(keys, F.transform("__hits", lambda e: F.size(e["hits"]))),
            f"{prefix}_examples": F.map_from_arrays(keys, F.transform("__hits", lambda e: hashed(e["hits"]))),
            "needs_manual_review": F.size("__hits") > 0,
        }
    ).drop("__hits")
