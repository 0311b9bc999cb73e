"""Declarative extraction over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as E, lines as L
from ..operators.extract import FieldRule, KeywordRule
from .registry import Tables, query

ASCII_DOCS = "(SELECT doc_id, source, lang, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents)"


def ascii_docs(t: Tables):
    return t.spread("documents").select("doc_id", "source", "lang", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))


# ---------------------------------------------------------------------------
# Regex fields
# ---------------------------------------------------------------------------
REGEX_RULES = [
    FieldRule("kata_akhir", r"([a-z]+)\.", ("assistant", "user")),
    FieldRule("ada_the", r"\sthe\s"),
    FieldRule("kalimat", r"\sthe\s+([a-z]+.{0,30})", ("user",), dotall=True),
    FieldRule("tak_ada", r"zzz(\d+)", ("user",)),
]
_ASCII_CONV = "(SELECT conv_id, turn, role, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM conversations)"
REGEX_SQL = f"""
WITH c AS (SELECT *, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 END AS p1, CASE role WHEN 'user' THEN 0 END AS p3 FROM {_ASCII_CONV}),
h AS (SELECT conv_id, 'kata_akhir' AS field, p1 AS prio, turn, trim(regexp_extract(text, '(?i)([a-z]+)\\.', 1)) AS v FROM c WHERE p1 IS NOT NULL AND regexp_matches(text, '(?i)([a-z]+)\\.')
 UNION ALL SELECT conv_id, 'ada_the', 99, turn, 'ada' FROM c WHERE regexp_matches(text, '(?i)\\sthe\\s')
 UNION ALL SELECT conv_id, 'kalimat', p3, turn, trim(regexp_replace(regexp_extract(text, '(?is)\\sthe\\s+([a-z]+.{{0,30}})', 1), '\\s+', ' ', 'g')) FROM c
  WHERE p3 IS NOT NULL AND regexp_matches(text, '(?is)\\sthe\\s+([a-z]+.{{0,30}})'))
SELECT conv_id AS patient_id, field, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, field ORDER BY prio, turn) AS rn FROM h) WHERE rn = 1"""


def ascii_conversations(t: Tables):
    return t.spread("conversations").select(
        F.col("conv_id").alias("patient_id"), "turn", F.col("role").alias("doc_type"), F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text")
    )


@query("E-01 W-01 J-02 J-04", REGEX_SQL)
def regex_fields(t: Tables):
    return E.regex_fields(ascii_conversations(t), REGEX_RULES, order="turn")


@query("E-49 E-01 U-03", f"""
WITH r AS ({REGEX_SQL}), p AS (SELECT DISTINCT conv_id AS patient_id FROM conversations)
SELECT p.patient_id, max(value) FILTER (field = 'kata_akhir') AS kata_akhir, max(value) FILTER (field = 'ada_the') AS ada_the, max(value) FILTER (field = 'kalimat') AS kalimat
FROM p LEFT JOIN r ON r.patient_id = p.patient_id GROUP BY 1""")
def profile_run(t: Tables):
    """A profile end to end: categories to rules, rules to a wide record."""
    from ..operators.profile_run import run_profile
    from ..sources.profiles import Category, Profile

    profile = Profile("Uji", [Category("Regex", "regex", ["kata_akhir", "ada_the", "kalimat"], regex=REGEX_RULES[:3])])
    docs = ascii_conversations(t).withColumn("source_file", F.lpad(F.col("turn").cast("string"), 6, "0"))
    return run_profile(docs, profile, wide=True)


CATEGORIES = {"Dasar": {"type": "regex", "fields": ["a1", "a2"], "patterns": {"a1": "\\shein\\s", "a2": "zzzz"}, "desc": "dasar"}}
EXTRA_CATEGORIES = {
    "Dasar": {"fields": ["a1"], "desc": "diganti", "patterns": {"a1": "tidak dipakai"}},
    "Baru": {"type": "regex", "fields": ["b1"], "patterns": {"b1": {"pattern": "\\s(nich[a-z]+)\\s", "doc_types": ["de"]}}},
}


@query("S-12 S-09 P-10", f"""
WITH d AS (SELECT source, doc_id, lang, text FROM {ASCII_DOCS}), p AS (SELECT DISTINCT source FROM d),
b AS (SELECT source, arg_min(lower(regexp_extract(text, '(?i)\\s(nich[a-z]+)\\s', 1)), doc_id) AS b1 FROM d WHERE lang = 'de' AND regexp_matches(text, '(?i)\\s(nich[a-z]+)\\s') GROUP BY 1),
a AS (SELECT source, 'ada' AS a1 FROM d WHERE regexp_matches(text, '(?i)\\shein\\s') GROUP BY 1)
SELECT p.source AS patient_id, a1, b1 FROM p LEFT JOIN a ON a.source = p.source LEFT JOIN b ON b.source = p.source""")
def overlaid_categories(t: Tables):
    """User categories over the base ones: fields replaced, extractor kept, new
    categories added; a catalogue of profiles picks the one to run."""
    from ..operators.profile_run import run_profile
    from ..sources.profiles import overlay_categories, parse_profile, select

    profile = parse_profile({"name": "Uji", "categories": overlay_categories(CATEGORIES, EXTRA_CATEGORIES)})
    docs = ascii_docs(t).select(
        F.col("source").alias("patient_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_file"), F.col("lang").alias("doc_type"), F.lower("text").alias("text")
    )
    return run_profile(docs, select(profile, ["Dasar", "Baru"]), wide=True)


# ---------------------------------------------------------------------------
# Keywords with negation
# ---------------------------------------------------------------------------
KEYWORD_RULES = [KeywordRule("f_than", ("than",)), KeywordRule("f_mix", ("hein", "with")), KeywordRule("f_none", ("qqqq",)), KeywordRule("f_pair", ("of the",))]


def negation_docs(t: Tables):
    """Documents in which two frequent words act as negation and affirmation."""
    x = F.regexp_replace(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "x")), r"\sthat\s", " tidak ")
    x = F.regexp_replace(x, r"\swas\s", " ada ")
    return t.spread("documents").select("source", "doc_id", x.alias("text"))


def _negation_sql(partition: str, words: list[tuple[str, list[str]]], key: str) -> str:
    flat = [(f, w) for f, ws in words for w in ws]
    neg = ", ".join(f"'{w}'" for w in E.NEGATION_WORDS)
    pos = ", ".join(f"'{w}'" for w in E.POSITIVE_MARKERS)
    per_word = "\n UNION ALL ".join(
        f"""SELECT {key} AS patient_id, '{f}' AS field, '{w}' AS word,
   bool_or(({'contains(tok, ' + repr(w) + ')' if ' ' not in w else 'false'}) AND near) AS affirmed,
   bool_or(({'contains(tok, ' + repr(w) + ')' if ' ' not in w else 'false'}) AND NOT near AND around) AS negated
  FROM w GROUP BY 1"""
        for f, w in flat
    )
    found = "\n UNION ALL ".join(
        f"SELECT DISTINCT {key} AS patient_id, '{f}' AS field, '{w}' AS word FROM d WHERE regexp_matches(text, '\\b{w}\\b')" for f, w in flat
    )
    return f"""
WITH d AS (SELECT source, doc_id, regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')), '\\sthat\\s', ' tidak ', 'g'), '\\swas\\s', ' ada ', 'g') AS text FROM documents),
tk AS (SELECT source, doc_id, toks[i] AS tok, i FROM (SELECT source, doc_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (
   SELECT source, doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS toks FROM d))),
w AS (SELECT *, coalesce(bool_or(tok IN ({pos}) OR contains(tok, '(+)')) OVER (PARTITION BY {partition} ORDER BY doc_id, i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), false) AS near,
  coalesce(bool_or(tok IN ({neg})) OVER (PARTITION BY {partition} ORDER BY doc_id, i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false)
  OR coalesce(bool_or(tok IN ({neg})) OVER (PARTITION BY {partition} ORDER BY doc_id, i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS around FROM tk),
n AS ({per_word}), f AS ({found})
SELECT f.patient_id, f.field, CASE WHEN bool_or(NOT n.negated OR n.affirmed) THEN 'ada' ELSE 'tidak' END AS value
FROM f JOIN n USING (patient_id, field, word) GROUP BY 1, 2"""


_WORDS = [(r.field, list(r.keywords)) for r in KEYWORD_RULES]


@query("E-02 E-03", _negation_sql("source", _WORDS, "source"))
def keyword_fields(t: Tables):
    """Windows may cross documents of a source: only edges travel."""
    return E.keyword_fields(negation_docs(t).withColumnRenamed("source", "patient_id"), KEYWORD_RULES, order="doc_id")


@query("E-03", _negation_sql("doc_id", _WORDS, "doc_id"))
def negation_per_document(t: Tables):
    d = negation_docs(t).select(F.col("doc_id").alias("patient_id"), "text")
    return E.keyword_fields(d, KEYWORD_RULES, order=None)


@query("E-29", """
SELECT source AS patient_id, unnest(['g1', 'g2']) AS field, CASE WHEN bool_or(contains(lower(text), 'thanish') OR contains(lower(text), 'ungheit')) THEN 'ada' ELSE 'tidak' END AS value
FROM documents GROUP BY 1""")
def generic_category(t: Tables):
    return E.generic_fields(t.spread("documents").withColumnRenamed("source", "patient_id"), ["g1", "g2"], ["Thanish", "UNGHEIT"])


TERMS = {"t_en": ["than the", "hein"], "t_de": ["nicht", "ungheit"]}


def _presence_sql() -> str:
    rows = "\n UNION ALL ".join(
        f"SELECT source AS patient_id, '{f}' AS field, doc_id, {i} AS term_pos, '{w}' AS kw, text, strpos(lower(text), '{w}') - 1 AS s, length(text) AS n FROM documents WHERE contains(lower(text), '{w}')"
        for f, ws in TERMS.items()
        for i, w in enumerate(ws)
    )
    return f"""WITH h AS ({rows}), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, field ORDER BY doc_id, term_pos) AS rank FROM h),
e AS (SELECT *, trim(regexp_replace(substring(text, greatest(s-120,0)+1, least(s+length(kw)+120,n)-greatest(s-120,0)), '\\s+', ' ', 'g')) AS ev FROM r WHERE rank <= 10)
SELECT patient_id, field, 'yes' AS value, arg_min(doc_id, rank) AS source_file, arg_min(ev, rank) AS evidence, string_agg(kw || ':' || doc_id, ',' ORDER BY rank) AS first_ten FROM e GROUP BY 1, 2"""


@query("E-35 J-03 W-07", _presence_sql())
def term_presence(t: Tables):
    d = t.spread("documents").withColumnRenamed("source", "patient_id")
    p = E.term_presence(d, TERMS, order="doc_id")
    listed = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["keyword"], c["source"].cast("string"))), ",")
    return p.select("patient_id", "field", "value", "source_file", "evidence", listed.alias("first_ten"))


@query("E-31 U-04", f"""
WITH h AS (SELECT source AS patient_id, doc_id, lang, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS pref, unnest([0,1,2]) AS tp FROM {ASCII_DOCS}
 ), m AS (SELECT h.*, ['hein','nicht','avec'][tp + 1] AS term FROM h JOIN {ASCII_DOCS} d ON d.doc_id = h.doc_id WHERE regexp_matches(d.text, '(?i)\\b' || ['hein','nicht','avec'][tp + 1] || '\\b')),
tt AS (SELECT patient_id, term, min(struct_pack(pref := pref, doc_id := doc_id, tp := tp)) AS spot FROM m GROUP BY 1, 2),
ss AS (SELECT patient_id, lang, min(struct_pack(pref := pref, doc_id := doc_id, tp := tp)) AS spot FROM m GROUP BY 1, 2)
SELECT a.patient_id, a.terms, b.sources FROM (SELECT patient_id, string_agg(term, ', ' ORDER BY spot) AS terms FROM tt GROUP BY 1) a
JOIN (SELECT patient_id, string_agg(lang, ', ' ORDER BY spot) AS sources FROM ss GROUP BY 1) b ON a.patient_id = b.patient_id""")
def terms_with_source(t: Tables):
    d = ascii_docs(t).withColumnRenamed("source", "patient_id")
    return E.terms_with_source(d, ["hein", "nicht", "avec"], ["de", "en"], order="doc_id", doc_type="lang")


@query("E-30", f"""
WITH v AS (SELECT source AS patient_id, doc_id, lang, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 ELSE 3 END AS pref,
 coalesce(nullif(trim(regexp_extract(text, '(?ims)zzz(\\w+)', 1)), ''), nullif(trim(regexp_extract(text, '(?ims)\\s(h[a-z]+e)\\s', 1)), '')) AS value FROM {ASCII_DOCS})
SELECT patient_id, value, lang AS source FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY pref, doc_id) AS rn FROM v WHERE value IS NOT NULL) WHERE rn = 1""")
def value_with_source(t: Tables):
    d = ascii_docs(t).withColumnRenamed("source", "patient_id")
    return E.value_with_source(d, [r"zzz(\w+)", r"\s(h[a-z]+e)\s"], ["de", "en"], order="doc_id", doc_type="lang")


@query("E-37 W-07", """
SELECT doc_id, unnest(list_slice(regexp_extract_all(text, '(?i)[a-z0-9]+@[a-z0-9.]+'), 1, 2)) AS hit FROM documents WHERE contains(text, '@')""")
def all_matches(t: Tables):
    d = t.spread("documents").filter(F.col("text").contains("@"))
    return d.select("doc_id", F.explode(E.all_matches("text", r"(?i)[a-z0-9]+@[a-z0-9.]+", 2)).alias("m")).select("doc_id", "m.hit")


DRUGS = {"med_a": ["hein", "than the"], "med_b": ["nicht"], "med_c": ["zzzz"], "_note": ["x"]}


def _drug_sql() -> str:
    units = E.DOSE_UNITS.replace("'", "''")
    rows = "\n UNION ALL ".join(
        f"""SELECT source AS patient_id, '{k}' AS drug_key, {i} AS tp, '{w}' AS term, doc_id, substring(low, strpos(low, '{w}'), {len(w) + 80}) AS t80, substring(low, strpos(low, '{w}'), {len(w) + 150}) AS t150 FROM d WHERE contains(low, '{w}')"""
        for k, ws in DRUGS.items()
        if k.startswith("med_")
        for i, w in enumerate(ws)
    )
    durations = ", ".join(
        f"CASE WHEN trim(regexp_extract(t150, '{p}')) <> '' AND length(trim(regexp_extract(t150, '{p}'))) < 50 THEN trim(regexp_extract(t150, '{p}')) END" for p in E.DURATION_PATTERNS
    )
    p1 = f"'(?i)(?:' || term || ')[\\s:,]*(\\d+[.,]?\\d*\\s*{units})(?:\\s*(?:/|per)\\s*(\\d+)\\s*(?:jam|hour|hari))?'"
    p2 = "'(?i)(\\d+\\s*[x×]\\s*\\d+[.,]?\\d*\\s*(?:g|mg|mcg|gr|gram|ml))'"
    p3 = "'(?i)(?:' || term || ')(?:.*?)(/\\d+\\s*(?:jam|hour))'"
    dose = ", ".join(f"CASE WHEN trim(regexp_extract(t80, {p})) <> '' AND length(trim(regexp_extract(t80, {p}))) < 60 THEN trim(regexp_extract(t80, {p})) END" for p in (p1, p2, p3))
    return f"""
WITH d AS (SELECT source, doc_id, lower(replace(text, 'hein ', 'hein 500mg/8 jam selama 7 hari ')) AS low FROM documents), h AS ({rows}),
f AS (SELECT *, row_number() OVER (PARTITION BY patient_id, drug_key, tp ORDER BY doc_id) AS rn FROM h),
g AS (SELECT patient_id, drug_key, tp, term, coalesce({dose}) AS dose, coalesce({durations}) AS duration FROM f WHERE rn = 1),
a AS (SELECT patient_id, drug_key, string_agg(term, ', ' ORDER BY tp) AS detail, list(dose ORDER BY tp) FILTER (dose IS NOT NULL) AS dl, list(duration ORDER BY tp) FILTER (duration IS NOT NULL) AS ul FROM g GROUP BY 1, 2),
s AS (SELECT source AS patient_id, k AS drug_key FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['med_a','med_b','med_c']) AS k))
SELECT s.patient_id, s.drug_key, CASE WHEN detail IS NULL THEN 'tidak' ELSE 'ada' END AS value, coalesce(detail, '') AS detail,
 left(coalesce(CASE WHEN len(dl) = 2 AND dl[1] = dl[2] THEN dl[1] ELSE array_to_string(dl, '; ') END, ''), 200) AS dose,
 left(coalesce(CASE WHEN len(ul) = 2 AND ul[1] = ul[2] THEN ul[1] ELSE array_to_string(ul, '; ') END, ''), 200) AS duration
FROM s LEFT JOIN a ON a.patient_id = s.patient_id AND a.drug_key = s.drug_key"""


@query("E-20 E-21 E-22 E-23 J-03 W-07", _drug_sql())
def medications(t: Tables):
    d = t.spread("documents").select(
        F.col("source").alias("patient_id"), "doc_id", F.replace("text", F.lit("hein "), F.lit("hein 500mg/8 jam selama 7 hari ")).alias("text")
    )
    return E.medications(d, DRUGS, order="doc_id")


# ---------------------------------------------------------------------------
# Lines
# ---------------------------------------------------------------------------
LINE_KEYWORDS = {"01_INGGRIS": ["the", "than"], "02_JERMAN": ["nicht", "und "], "03_PRANCIS": ["que"]}
LINE_PATTERNS = {"02_JERMAN": [r"\d{4,}"], "04_SUREL": [r"@[a-z]"]}
LINES_SQL = """
l AS (SELECT doc_id, i, trim(regexp_replace(lines[i], '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
c AS (SELECT doc_id, i, line, contains(lower(line), 'the') OR contains(lower(line), 'than') AS c1, contains(lower(line), 'nicht') OR contains(lower(line), 'und ') OR regexp_matches(line, '\\d{4,}') AS c2,
 contains(lower(line), 'que') AS c3, regexp_matches(line, '(?i)@[a-z]') AS c4 FROM l),
n AS (SELECT *, lag(c1, 1, false) OVER w AS b1, lead(c1, 1, false) OVER w AS a1, lag(c2, 1, false) OVER w AS b2, lead(c2, 1, false) OVER w AS a2,
 lag(c3, 1, false) OVER w AS b3, lead(c3, 1, false) OVER w AS a3, lag(c4, 1, false) OVER w AS b4, lead(c4, 1, false) OVER w AS a4 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, line, '01_INGGRIS' AS category FROM n WHERE c1 OR a1 OR b1 UNION ALL SELECT doc_id, i, line, '02_JERMAN' FROM n WHERE c2 OR a2 OR b2
 UNION ALL SELECT doc_id, i, line, '03_PRANCIS' FROM n WHERE c3 OR a3 OR b3 UNION ALL SELECT doc_id, i, line, '04_SUREL' FROM n WHERE c4 OR a4 OR b4),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category, trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '\\d{1,2}[:.]\\d{2}', '[TIME]', 'g'),
 '\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4}', '[DATE]', 'g'), '\\s+', ' ', 'g')) ORDER BY i) AS rn FROM s WHERE line <> ''),
p AS (SELECT doc_id, category, i AS line_no, line FROM k WHERE rn = 1)"""


@query("E-43", f"""WITH {LINES_SQL} SELECT doc_id, i AS line_no, list_filter(['01_INGGRIS','02_JERMAN','03_PRANCIS','04_SUREL'], lambda x, j: [c1, c2, c3, c4][j]) AS categories FROM c WHERE c1 OR c2 OR c3 OR c4""")
def line_categories(t: Tables):
    d = t.spread("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    cats = L.line_categories(T.clean_line("line"), LINE_KEYWORDS, LINE_PATTERNS)
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), cats.alias("categories")).filter(F.size("categories") > 0)


@query("E-44 J-10 W-04", f"WITH {LINES_SQL} SELECT doc_id, category, line_no, line FROM p")
def context_dedup(t: Tables):
    d = L.categorized_lines(t.spread("documents").select("doc_id", "text"), ["doc_id"], LINE_KEYWORDS, LINE_PATTERNS)
    return d.withColumn("line_no", F.col("line_no").cast("long"))


@query("A-23", f"""WITH {LINES_SQL}, t AS (SELECT doc_id, count(*) AS total_lines FROM l GROUP BY 1),
g AS (SELECT doc_id, count(*) AS selected_lines, count(DISTINCT category) AS n_categories, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories FROM p GROUP BY 1)
SELECT t.doc_id, total_lines, coalesce(selected_lines, 0) AS selected_lines, coalesce(n_categories, 0) AS n_categories, coalesce(categories, '') AS categories FROM t LEFT JOIN g ON g.doc_id = t.doc_id""")
def category_log(t: Tables):
    return L.category_log(t.spread("documents").select("doc_id", "text"), ["doc_id"], LINE_KEYWORDS, LINE_PATTERNS)


@query("S-26", f"""WITH {LINES_SQL}, b AS (SELECT doc_id, category, string_agg('[L' || line_no || '] ' || line, chr(10) ORDER BY line_no) AS body FROM p GROUP BY 1, 2),
sp AS (SELECT doc_id, unnest(['01_INGGRIS','02_JERMAN','03_PRANCIS','04_SUREL']) AS category FROM documents)
SELECT sp.doc_id, sp.category, coalesce(body, '[tidak terdeteksi]') AS body FROM sp LEFT JOIN b ON b.doc_id = sp.doc_id AND b.category = sp.category""")
def category_texts(t: Tables):
    return L.render_categories(t.spread("documents").select("doc_id", "text"), ["doc_id"], LINE_KEYWORDS, LINE_PATTERNS)


BLOCKS_SQL = """
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, line FROM (SELECT doc_id, i, trim(regexp_replace(lines[i], '\\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) WHERE line <> ''),
r AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '[.!?;:]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM l),
q AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY i) - 1) // 4 AS part FROM r),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS block_no, string_agg(line, ' ' ORDER BY i) AS block FROM q GROUP BY doc_id, run, part)"""


@query("E-45", f"WITH {BLOCKS_SQL} SELECT doc_id, block_no, block FROM b")
def soft_paragraphs(t: Tables):
    d = t.spread("documents").select("doc_id", F.posexplode(L.soft_paragraphs("text")).alias("pos", "block"))
    return d.select("doc_id", F.col("pos").cast("long").alias("block_no"), "block")


@query("E-46", f"""
SELECT doc_id, list_filter(['the', 'der', 'hein', 'than the'], lambda k: CASE WHEN length(k) <= 3 THEN regexp_matches(lower(text), '\\b' || k || '\\b') ELSE contains(lower(text), k) END) AS found FROM {ASCII_DOCS}""")
def keyword_found(t: Tables):
    return ascii_docs(t).select("doc_id", L.keywords_found("text", ["the", "der", "hein", "than the"]).alias("found"))


SNIPPET_GROUPS = {"DIAG": ["hein", "thanish"], "LAB": ["nicht", "ungheit", "tion"]}
SNIPPETS_SQL = f"""{BLOCKS_SQL},
w AS (SELECT *, CASE WHEN lag(block) OVER x IS NULL THEN '' ELSE lag(block) OVER x || ' ' END || block || coalesce(' ' || lead(block) OVER x, '') AS j FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY block_no)),
g AS (SELECT doc_id, 'DIAG' AS "group", block_no, list_filter(['hein','thanish'], lambda k: contains(lower(block), k)) AS matched, j FROM w
 UNION ALL SELECT doc_id, 'LAB', block_no, list_filter(['nicht','tion','ungheit'], lambda k: contains(lower(block), k)), j FROM w),
h AS (SELECT doc_id, "group", block_no, matched, CASE WHEN length(j) > 650 THEN left(j, 650) || ' ...[truncated]' ELSE j END AS snippet FROM g WHERE len(matched) > 0),
d AS (SELECT *, md5(trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g'))) AS hash FROM h),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "group", hash ORDER BY block_no) AS rn FROM d),
tp AS (SELECT doc_id, "group", block_no, matched, snippet, hash, row_number() OVER (PARTITION BY doc_id, "group" ORDER BY block_no) AS rank FROM u WHERE rn = 1)"""


@query("E-47 E-46 W-07", f"""WITH {SNIPPETS_SQL} SELECT doc_id, "group", block_no, matched, snippet, rank FROM tp WHERE rank <= CASE "group" WHEN 'DIAG' THEN 3 ELSE 4 END""")
def compact_snippets(t: Tables):
    s = L.compact_snippets(t.spread("documents").select("doc_id", "text"), ["doc_id"], SNIPPET_GROUPS)
    top = L.top_snippets(s, ["doc_id"], {"DIAG": 3, "LAB": 4})
    return top.select("doc_id", "group", F.col("block_no").cast("long").alias("block_no"), "matched", "snippet", F.col("rank").cast("long").alias("rank"))


@query("E-48 W-10", f"""WITH {SNIPPETS_SQL}, o AS (SELECT source, tp.* FROM tp JOIN documents USING (doc_id) WHERE rank <= CASE "group" WHEN 'DIAG' THEN 3 ELSE 4 END),
fi AS (SELECT *, row_number() OVER (PARTITION BY source, hash ORDER BY doc_id, "group", block_no) AS rn FROM o),
ra AS (SELECT *, row_number() OVER (PARTITION BY source, "group" ORDER BY doc_id, block_no) AS place FROM fi WHERE rn = 1)
SELECT source, doc_id, "group", snippet, place FROM ra WHERE place <= CASE "group" WHEN 'DIAG' THEN 3 ELSE 4 END""")
def patient_context(t: Tables):
    limits = {"DIAG": 3, "LAB": 4}
    s = L.compact_snippets(t.spread("documents").select("source", "doc_id", "text"), ["source", "doc_id"], SNIPPET_GROUPS)
    ctx = L.patient_context(L.top_snippets(s, ["source", "doc_id"], limits).drop("rank"), "source", ["doc_id"], limits)
    return ctx.select("source", "doc_id", "group", "snippet", F.col("rank").cast("long").alias("place"))


CONTEXT_GROUPS = {"LAB": ["nicht", "ungheit", "tion"], "DIAGNOSIS_STROKE": ["hein", "thanish"], "NEURO_EXAM": ["ment", "keit"], "OUTCOME_LOS": ["than the"]}
CONTEXT_QUOTAS = {"LAB": 4, "DIAGNOSIS_STROKE": 3, "NEURO_EXAM": 3, "OUTCOME_LOS": 2}
CONTEXT_FILES = ["resume", "rad", "lab", "cppt_igd", "cppt_ranap", "surat"]
CONTEXT_TYPES = ["resume", "radiology", "lab", "cppt_igd", "cppt_ranap", "other"]
SHOWN = {
    "LAB": ["lab", "resume", "other"], "DIAGNOSIS_STROKE": ["radiology", "resume", "cppt_igd", "other"],
    "NEURO_EXAM": ["resume", "cppt_igd", "cppt_ranap", "other"], "OUTCOME_LOS": ["resume", "cppt_ranap", "other"],
}
WRITTEN = ["DIAGNOSIS_STROKE", "ONSET_CHIEF_COMPLAINT", "NEURO_EXAM", "VITAL_SIGNS", "RADIOLOGY_CT", "LAB", "THERAPY_CP_AUDIT", "OUTCOME_LOS"]


def _context_sql() -> str:
    quota = "CASE grp " + " ".join(f"WHEN '{g}' THEN {n}" for g, n in CONTEXT_QUOTAS.items()) + " END"
    hits = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS search_no, '{g}' AS grp, block_no, list_filter({sorted(ws)!r}, lambda k: contains(lower(block), k)) AS matched, j FROM w JOIN dd USING (doc_id) WHERE doc_type IN ({', '.join(repr(x) for x in SHOWN[g])})"
        for n, (g, ws) in enumerate(CONTEXT_GROUPS.items())
    )
    sections = " || ".join(
        f"chr(10) || chr(10) || '===== {g} =====' || chr(10) || coalesce((SELECT string_agg(entry, chr(10) ORDER BY nth) FROM sh WHERE sh.patient_id = p.patient_id AND grp = '{g}'), '[NO RELEVANT SNIPPET FOUND]')"
        for g in WRITTEN
    )
    return f"""WITH {BLOCKS_SQL},
dd AS (SELECT doc_id, source || '/' || (doc_id // 100) AS patient_id, {CONTEXT_TYPES!r}[doc_id % 6 + 1] AS doc_type, [1,2,3,4,5,9][doc_id % 6 + 1] AS prio, {CONTEXT_FILES!r}[doc_id % 6 + 1] || '_' || doc_id || '.txt' AS file FROM documents),
w AS (SELECT *, CASE WHEN lag(block) OVER x IS NULL THEN '' ELSE lag(block) OVER x || ' ' END || block || coalesce(' ' || lead(block) OVER x, '') AS j FROM b WINDOW x AS (PARTITION BY doc_id ORDER BY block_no)),
h AS (SELECT doc_id, search_no, grp, block_no, matched, CASE WHEN length(j) > 650 THEN left(j, 650) || ' ...[truncated]' ELSE j END AS snippet FROM ({hits}) WHERE len(matched) > 0),
d AS (SELECT *, md5(trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g'))) AS hash FROM h),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, hash ORDER BY block_no) AS rn FROM d),
tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY block_no) AS place FROM u WHERE rn = 1),
o AS (SELECT dd.patient_id, prio, file, doc_type, search_no, grp, block_no, matched, snippet, hash FROM tp JOIN dd USING (doc_id) WHERE place <= CASE WHEN doc_type = 'cppt_ranap' THEN least({quota}, 2) ELSE {quota} END),
fi AS (SELECT *, row_number() OVER (PARTITION BY patient_id, hash ORDER BY prio, file, search_no, block_no) AS f FROM o),
ra AS (SELECT *, row_number() OVER (PARTITION BY patient_id, grp ORDER BY prio, file, search_no, block_no) AS nth FROM fi WHERE f = 1),
sh AS (SELECT patient_id, grp, nth, chr(10) || '[' || nth || '] source: ' || file || ' | doc_type: ' || doc_type || ' | matched: ' || array_to_string(matched, ', ') || chr(10) || snippet AS entry FROM ra WHERE nth <= {quota}),
p AS (SELECT patient_id, count(*) AS n_documents, string_agg('- ' || file || ' | doc_type: ' || doc_type, chr(10) ORDER BY prio, file) AS listed FROM dd GROUP BY 1),
t AS (SELECT patient_id, n_documents, (SELECT count(*) FROM sh WHERE sh.patient_id = p.patient_id) AS n_snippets,
 'PATIENT_ID: ' || patient_id || chr(10) || chr(10) || '===== DOCUMENTS FOUND =====' || chr(10) || listed || chr(10) || chr(10) || '===== INSTRUCTION FOR LLM =====' || chr(10)
 || 'Filtered anonymized EMR context.' || chr(10) || 'Extract only explicitly documented information.' || chr(10) || 'Do not guess undocumented NIHSS, mRS, onset, diagnosis, or treatment.' || chr(10)
 || 'Use unknown if not found and unclear if ambiguous.' || chr(10) || {sections} AS whole FROM p),
c AS (SELECT *, CASE WHEN length(whole) > 8000 THEN left(whole, 8000) || chr(10) || chr(10) || '...[OUTPUT TRUNCATED AT 8000 CHARACTERS FOR LOCAL LLM]' ELSE whole END AS context FROM t)
SELECT patient_id, context, length(context) AS n_chars, n_documents, n_snippets FROM c"""


@query("E-48 E-47 E-46 E-45 P-19 W-07 W-08 W-10", _context_sql())
def context_texts(t: Tables):
    """Documents to the text of a patient: order of types, allowed groups, quotas per
    document and patient, snippets once per patient, budget."""
    from ..operators import classify as C, context as X

    i = F.col("doc_id")
    name = F.concat(F.element_at(F.array(*[F.lit(f) for f in CONTEXT_FILES]), (i % 6 + 1).cast("int")), F.lit("_"), i.cast("string"), F.lit(".txt"))
    d = t.spread("documents").select(F.concat("source", F.lit("/"), F.floor(i / 100).cast("string")).alias("patient_id"), name.alias("source_file"), "text")
    return X.context_texts(d.withColumn("doc_type", C.doc_type_by_name("source_file")), X.ContextRules(CONTEXT_GROUPS, quotas=CONTEXT_QUOTAS))
