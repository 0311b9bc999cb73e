"""The bounded context of a patient, from documents to one text.

Documents are read in order of type and file name.  Each gives, per keyword group
that its type may show, a few snippets; a snippet seen before in the patient's
documents is left out, and each group keeps its first ones.  The text lists the
documents, then the groups, and ends at a budget of characters.

The choice is made on narrow rows - order, group, place, digest.  Snippets are
cut inside their document's row, are few per document, and only chosen ones are
put together, so what a task holds for a patient depends on quotas and budget,
never on how many documents the patient has."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..rows import explode_structs
from .classify import GROUPS_BY_TYPE, doc_priority
from .lines import CONTEXT_CHARS, SNIPPET_CHARS, keyword_test, snippet_hash, soft_paragraphs

# Order of types and groups, quotas, texts of the frame.
TYPE_ORDER = {"resume": 1, "radiology": 2, "lab": 3, "cppt_igd": 4, "cppt_ranap": 5, "other": 9}
GROUP_ORDER = [
    "DIAGNOSIS_STROKE", "ONSET_CHIEF_COMPLAINT", "NEURO_EXAM", "VITAL_SIGNS", "RADIOLOGY_CT", "LAB", "THERAPY_CP_AUDIT", "OUTCOME_LOS",
]
GROUP_QUOTAS = {
    "DIAGNOSIS_STROKE": 3, "ONSET_CHIEF_COMPLAINT": 3, "NEURO_EXAM": 3, "VITAL_SIGNS": 2, "LAB": 4, "RADIOLOGY_CT": 4, "THERAPY_CP_AUDIT": 4, "OUTCOME_LOS": 2,
}
TYPE_QUOTAS = {"cppt_ranap": 2}
INSTRUCTIONS = [
    "===== INSTRUCTION FOR LLM =====", "Filtered anonymized EMR context.", "Extract only explicitly documented information.",
    "Do not guess undocumented NIHSS, mRS, onset, diagnosis, or treatment.", "Use unknown if not found and unclear if ambiguous.", "",
]
DOCUMENTS_TITLE, NOTHING_FOUND = "===== DOCUMENTS FOUND =====", "[NO RELEVANT SNIPPET FOUND]"
CUT_NOTE = "\n\n...[OUTPUT TRUNCATED AT {budget} CHARACTERS FOR LOCAL LLM]"
SHORTEST_DOCUMENT_LINE = len("-  | doc_type: ") + 1


@dataclass(frozen=True)
class ContextRules:
    """Keyword groups in the order in which a document is searched for them; the
    order in which they are written; quotas per document and patient."""

    groups: dict[str, list[str]]
    order: list[str] = dc_field(default_factory=lambda: list(GROUP_ORDER))
    quotas: dict[str, int] = dc_field(default_factory=lambda: dict(GROUP_QUOTAS))
    default_quota: int = 3
    type_quotas: dict[str, int] = dc_field(default_factory=lambda: dict(TYPE_QUOTAS))
    allowed: dict[str, list[str]] = dc_field(default_factory=lambda: dict(GROUPS_BY_TYPE))
    type_order: dict[str, int] = dc_field(default_factory=lambda: dict(TYPE_ORDER))
    budget: int = CONTEXT_CHARS
    snippet_chars: int = SNIPPET_CHARS
    cut_note: str = CUT_NOTE

    def quota(self, group: str) -> int:
        return self.quotas.get(group, self.default_quota)


FOUND = "array<struct<block_no:int,matched:array<string>,snippet:string,hash:string>>"


def document_snippets(blocks: Column, words: list[str], quota: Column, max_chars: int = SNIPPET_CHARS) -> Column:
    """First ``quota`` different snippets of a document: a block with a keyword,
    with its neighbours.  One fold over the blocks; a block is looked at only while
    there is room, so a long document costs one test a block."""

    def step(found: Column, x: Column) -> Column:
        low = F.lower(x["block"])
        joined = F.array_join(F.array_compact(F.array(x["before"], x["block"], x["after"])), " ")
        cut = F.when(F.length(joined) > max_chars, F.concat(F.substring(joined, 1, max_chars), F.lit(T.TRUNCATED))).otherwise(joined)
        matched = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(keyword_test(low, w), F.lit(w)) for w in words]))))
        entry = T.let(cut, lambda s: F.struct(x["block_no"].alias("block_no"), matched.alias("matched"), s.alias("snippet"), snippet_hash(s).alias("hash")))
        added = T.let(entry, lambda e: F.when(F.exists(found, lambda f: f["hash"] == e["hash"]), found).otherwise(F.concat(found, F.array(e))))
        hit = reduce(lambda a, b: a | b, [keyword_test(low, w) for w in words])
        return F.when((F.size(found) < quota) & hit, added).otherwise(found)

    return F.aggregate(blocks, F.array().cast(FOUND), step)


def with_neighbours(blocks: str) -> Column:
    """The blocks of a text, numbered, each beside the ones before and after it."""
    n = F.size(blocks)
    none = F.array(F.lit(None).cast("string"))
    beside = F.arrays_zip(
        F.col(blocks).alias("block"), F.concat(none, F.slice(blocks, 1, n - 1)).alias("before"), F.concat(F.slice(blocks, 2, n), none).alias("after")
    )
    numbered = F.transform(beside, lambda x, i: F.struct(i.alias("block_no"), x["block"].alias("block"), x["before"].alias("before"), x["after"].alias("after")))
    return F.when(n > 0, numbered)


def searched(docs: DataFrame, rules: ContextRules, patient: str, file: str, doc_type: str, text: str) -> DataFrame:
    """``(patient, rank, file, doc_type, found)``: ``found`` is one array a group."""
    numbered = docs.select(
        F.col(patient).alias("patient"), F.struct(doc_priority(doc_type, rules.type_order).alias("type_rank"), F.lower(file).alias("low_name"), F.col(file).alias("file")).alias("place"),
        F.col(doc_type).alias("doc_type"), soft_paragraphs(text).alias("__p"),
    ).withColumn("__b", with_neighbours("__p"))
    found = []
    for group, words in rules.groups.items():
        quota = reduce(
            lambda rest, kv: F.when(F.col("doc_type") == kv[0], F.lit(min(kv[1], rules.quota(group)))).otherwise(rest), rules.type_quotas.items(), F.lit(rules.quota(group))
        )
        shown = reduce(lambda rest, kv: F.when(F.col("doc_type") == kv[0], F.lit(group in kv[1])).otherwise(rest), rules.allowed.items(), F.lit(True))
        found.append(F.when(shown, document_snippets(F.col("__b"), words, quota, rules.snippet_chars)))

    def labelled(n: int, group: str, entries: Column) -> Column:
        fields = ("block_no", "matched", "snippet", "hash")
        return F.transform(entries, lambda e: F.struct(F.lit(n).alias("search_no"), F.lit(group).alias("group"), *[e[f].alias(f) for f in fields]))

    none = F.array().cast(FOUND)
    entries = [labelled(n, group, F.coalesce(f, none)) for n, (group, f) in enumerate(zip(rules.groups, found))]
    return numbered.select("patient", "place", "doc_type", F.concat(*entries).alias("found"))


def chosen_snippets(snippets: DataFrame, rules: ContextRules) -> DataFrame:
    """``(patient, place, search_no, block_no, group, nth)`` of the snippets a
    context shows.  Only keys and digests are shuffled: the first place of a digest
    is an aggregate that combines before its shuffle, and each task sends on at most
    a quota of rows per patient and group."""
    at = F.struct("place", "search_no", "block_no")
    first = snippets.groupBy("patient", "hash").agg(F.min(at).alias("at"), F.min_by("group", at).alias("group"))
    quota = reduce(lambda rest, g: F.when(F.col("group") == g, F.lit(rules.quota(g))).otherwise(rest), rules.groups, F.lit(rules.default_quota))
    most = max([rules.default_quota, *[rules.quota(g) for g in rules.groups]])
    w = Window.partitionBy("patient", "group").orderBy("at")
    ranked = first.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).filter(F.col("nth") <= quota)
    return ranked.select("patient", "at.*", "group", "nth")


def context_texts(
    docs: DataFrame, rules: ContextRules, patient: str = "patient_id", file: str = "source_file", doc_type: str = "doc_type", text: str = "text",
) -> DataFrame:
    """One row per patient: ``(patient, context, n_chars, n_documents, n_snippets)``.

    A patient without a snippet has a context too.  Documents with a null or empty
    text are listed and give no snippet; a null patient is a patient.  ``file`` is
    taken as unique within a patient (equal names give equal rows one time)."""
    found = searched(docs, rules, patient, file, doc_type, text)
    rows = explode_structs(found.withColumn("doc_type", F.coalesce("doc_type", F.lit(""))), ["patient", "place", "doc_type"], "found")
    picks = chosen_snippets(rows.select("patient", "place", "search_no", "block_no", "group", "hash"), rules)

    # texts last: the rows of chosen places (the search runs again; nothing of it is kept)
    p, r = picks.alias("p"), rows.alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("patient", "place", "search_no", "block_no")])
    entry = F.concat(
        F.lit("\n["), F.col("p.nth").cast("string"), F.lit("] source: "), F.col("r.place.file"), F.lit(" | doc_type: "), F.col("r.doc_type"),
        F.lit(" | matched: "), F.array_join("r.matched", ", "), F.lit("\n"), F.col("r.snippet"),
    )
    shown = r.join(p, same).select("p.patient", "p.group", "p.nth", entry.alias("entry")).dropDuplicates(["patient", "group", "nth"])
    groups = shown.groupBy("patient").agg(F.collect_list(F.struct("group", "nth", "entry")).alias("entries"))

    # the list of documents: no more lines than the budget can hold
    listed = found.select("patient", "place", F.concat(F.lit("- "), F.col("place.file"), F.lit(" | doc_type: "), F.coalesce("doc_type", F.lit(""))).alias("line"))
    lines = rules.budget // SHORTEST_DOCUMENT_LINE + 1
    top = listed.withColumn("nth", F.row_number().over(Window.partitionBy("patient").orderBy("place"))).filter(F.col("nth") <= lines)
    counts = docs.groupBy(F.col(patient).alias("patient")).agg(F.count(F.lit(1)).alias("n_documents"))
    heads = top.groupBy("patient").agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("docs"))

    def section(group: str) -> Column:
        own = F.array_sort(F.filter(F.col("entries"), lambda e: e["group"] == group))
        body = F.array_join(F.transform(own, lambda e: e["entry"]), "\n")
        return F.concat(F.lit(f"\n===== {group} =====\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit(NOTHING_FOUND)))

    null_safe = lambda a, b: a.patient.eqNullSafe(b.patient)
    joined = heads.join(counts, null_safe(heads, counts)).drop(counts.patient).join(groups, null_safe(heads, groups), "left").drop(groups.patient)
    whole = F.concat_ws(
        "\n", F.concat(F.lit("PATIENT_ID: "), F.coalesce(F.col("patient").cast("string"), F.lit(""))), F.lit(""), F.lit(DOCUMENTS_TITLE),
        F.array_join(F.transform("docs", lambda d: d["line"]), "\n"), F.lit(""), *[F.lit(x) for x in INSTRUCTIONS], *[section(g) for g in rules.order],
    )
    full = joined.select(
        F.col("patient").alias(patient), whole.alias("whole"), "n_documents", F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("n_snippets")
    )
    note = F.lit(rules.cut_note.format(budget=rules.budget))
    context = F.when(F.length("whole") > rules.budget, F.concat(F.substring("whole", 1, rules.budget), note)).otherwise(F.col("whole"))
    return full.select(patient, context.alias("context"), F.length(context).cast("long").alias("n_chars"), "n_documents", "n_snippets")
