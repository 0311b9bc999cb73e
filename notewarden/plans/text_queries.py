"""Normalising, snippets, classification and value checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C, records as Rec
from .registry import Tables, query

NBSP = " "


def messy(t: Tables):
    """Documents with the line ends and blanks that normalising removes."""
    x = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    x = F.replace(x, F.lit(" the "), F.lit(" \t the  "))
    x = F.replace(x, F.lit(", "), F.lit("," + NBSP))
    return t.documents.select("doc_id", F.replace(x, F.lit(". "), F.lit(".\n\n\n\n")).alias("text"))


MESSY_SQL = """(SELECT doc_id, replace(replace(replace(replace(text, chr(10), chr(13)||chr(10)), ' the ', ' '||chr(9)||' the  '),
  ', ', ','||chr(160)), '. ', '.'||repeat(chr(10),4)) AS text FROM documents)"""
NORM_SQL = "regexp_replace(replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '[ \\t]+', ' ', 'g')"


@query("P-01 P-02 P-25", f"""
SELECT doc_id, norm, regexp_replace(norm, '\\n{{3,}}', chr(10)||chr(10), 'g') AS squeezed,
  trim(regexp_replace(norm, '\\s+', ' ', 'g')) AS one_line
FROM (SELECT doc_id, {NORM_SQL} AS norm FROM {MESSY_SQL})""")
def normalize_documents(t: Tables):
    d = messy(t).withColumn("norm", T.normalize("text"))
    return d.select("doc_id", "norm", T.squeeze_blank_lines("norm").alias("squeezed"), T.clean_line("norm").alias("one_line"))


@query("P-03", """
SELECT doc_id, CASE WHEN length(c) > 500 THEN left(c, 500) || ' ...[truncated]' ELSE c END AS snippet, CAST(length(c) AS BIGINT) AS n
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)""")
def snippets(t: Tables):
    return t.documents.select(
        "doc_id", T.clean_snippet("text").alias("snippet"), F.length(T.collapse_space("text")).cast("long").alias("n")
    )


@query("P-04 P-05", """
WITH h AS (SELECT doc_id, text, strpos(lower(text), 'ing') - 1 AS s, length(text) AS n FROM documents WHERE contains(lower(text), 'ing')),
c AS (SELECT doc_id, s, n,
  trim(regexp_replace(substring(text, greatest(s-100,0)+1, least(s+103,n)-greatest(s-100,0)), '\\s+', ' ', 'g')) AS w,
  trim(regexp_replace(replace(substring(text, greatest(s-40,0)+1, least(s+43,n)-greatest(s-40,0)), chr(10), ' '), '\\s{2,}', ' ', 'g')) AS l
  FROM h)
SELECT doc_id, CASE WHEN length(w) > 450 THEN left(w,450)||' ...[truncated]' ELSE w END AS window_text,
  (CASE WHEN s > 40 THEN '…' ELSE '' END) || l || (CASE WHEN s+43 < n THEN '…' ELSE '' END) AS leak_text FROM c""")
def char_contexts(t: Tables):
    d = t.documents.filter(F.lower("text").contains("ing")).withColumn("s", F.instr(F.lower("text"), "ing") - 1)
    s, e = F.col("s"), F.col("s") + 3
    return d.select(
        "doc_id", T.char_context("text", s, e).alias("window_text"), T.leak_context("text", s, e).alias("leak_text")
    )


@query("P-09 E-51", """
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS char_count,
  CASE WHEN length(regexp_replace(text,'\\s+','','g')) < 50 THEN 'Perlu OCR manual' ELSE 'Terbaca' END AS status, role AS doc_type
FROM conversations WHERE length(regexp_replace(text,'^\\s+|\\s+$','','g')) >= 20""")
def drop_short_docs(t: Tables):
    d = C.keep_long(t.conversations.withColumnRenamed("role", "doc_type"))
    return Rec.inventory(d, ["conv_id", "turn"]).withColumn("char_count", F.col("char_count").cast("long"))


@query("P-16 P-12", """
SELECT doc_id, coalesce(nullif(regexp_extract(replace(text, ',', '.'), '\\d+(?:\\.\\d+)?'), ''), 'unknown') AS number,
  nullif(regexp_extract(replace(text, ',', '.'), '\\d+(?:\\.\\d+)?'), '') AS number_or_null FROM documents""")
def first_numbers(t: Tables):
    d = t.documents.select("doc_id", T.first_number("text").alias("number"))
    return d.withColumn("number_or_null", T.missing_to_null("number"))


# File names as a folder tree would hold them.
NAMES = ["Resume_medis.txt", "rad_ct_kepala.txt", "lab_igd.txt", "cppt_igd.txt", "cppt_ranap_anonim.txt", "catatan.txt", "CPPT_rawat.txt", "ringkasan.txt", "hasil_ct.txt", "rawat_inap.txt"]


def with_names(t: Tables):
    return t.documents.withColumn("source_file", F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int")))


NAMES_SQL = "[" + ",".join(f"'{n}'" for n in NAMES) + "][doc_id % 10 + 1]"


@query("P-06 P-07 W-10", f"""
SELECT doc_id, source_file,
 CASE WHEN contains(n,'resume') THEN 'resume' WHEN contains(n,'rad') THEN 'radiology' WHEN contains(n,'lab') THEN 'lab'
  WHEN contains(n,'cppt_igd') THEN 'cppt_igd' WHEN contains(n,'ranap') THEN 'cppt_ranap' ELSE 'other' END AS doc_type,
 CASE WHEN contains(n,'resume') THEN 'resume' WHEN contains(n,'rad') OR contains(n,'ct') THEN 'radiology' WHEN contains(n,'lab') THEN 'lab'
  WHEN contains(n,'cppt') AND contains(n,'igd') THEN 'cppt_igd' WHEN contains(n,'ranap') OR contains(n,'rawat_inap') THEN 'cppt_ranap' ELSE 'other' END AS wide_type,
 CASE WHEN starts_with(n,'lab') THEN 'lab' WHEN starts_with(n,'rad') THEN 'radiologi' WHEN regexp_matches(s,'cppt.*(igd|ugd|er\\b)') THEN 'cppt_igd'
  WHEN regexp_matches(s,'cppt.*(ranap|inap|rawat)') THEN 'cppt_ranap' WHEN regexp_matches(s,'^(resume|ringkasan|discharge|lembar_resume)') THEN 'resume'
  WHEN starts_with(s,'cppt') THEN 'cppt_ranap' ELSE 'unknown' END AS role,
 CASE WHEN contains(n,'resume') THEN 1 WHEN contains(n,'rad') THEN 2 WHEN contains(n,'lab') THEN 3
  WHEN contains(n,'cppt_igd') THEN 4 WHEN contains(n,'ranap') THEN 5 ELSE 9 END AS priority
FROM (SELECT *, lower(source_file) AS n, regexp_replace(replace(lower(source_file),'.txt',''),'_anonim$','') AS s
  FROM (SELECT doc_id, {NAMES_SQL} AS source_file FROM documents))""")
def doc_type_by_name(t: Tables):
    d = with_names(t).select("doc_id", "source_file", C.doc_type_by_name("source_file").alias("doc_type"))
    return d.withColumns(
        {
            "wide_type": C.doc_type_by_name_wide("source_file"),
            "role": C.file_role(F.replace(F.lower("source_file"), F.lit(".txt"), F.lit(""))),
            "priority": C.doc_priority("doc_type"),
        }
    )


LANGUAGE_CLASSES = {
    "EN": [r"\sthe\s", r"\sand\s", r"\sthat\s", r"\swas\s"],
    "DE": [r"\sder\s", r"\sund\s", r"\sdie\s", r"\snicht\s"],
    "FR": [r"\sle\s", r"\sles\s", r"\sque\s", r"\sdes\s"],
    "ES": [r"\sel\s", r"\slos\s", r"\sque\s", r"\spor\s"],
}


def _score_sql(patterns):
    return " + ".join(f"CAST(regexp_matches(x, '{p}') AS INT)" for p in patterns)


@query("P-08", f"""
WITH s AS (SELECT doc_id, {", ".join(f"{_score_sql(p)} AS {c}" for c, p in LANGUAGE_CLASSES.items())} FROM (SELECT doc_id, lower(text) AS x FROM documents)),
m AS (SELECT *, greatest(EN, DE, FR, ES) AS best FROM s)
SELECT doc_id, CASE WHEN best = 0 THEN 'LAINNYA' WHEN EN = best THEN 'EN' WHEN DE = best THEN 'DE' WHEN FR = best THEN 'FR' ELSE 'ES' END AS doc_class,
 best AS score FROM m""")
def doc_class_by_score(t: Tables):
    d = t.spread("documents")
    scores = C.content_scores("text", LANGUAGE_CLASSES)
    return d.select("doc_id", C.class_by_content("text", LANGUAGE_CLASSES).alias("doc_class"), scores.alias("s")).select(
        "doc_id", "doc_class", F.greatest(*[F.col(f"s.{c}") for c in LANGUAGE_CLASSES]).alias("score")
    )


GROUPS = ["DIAGNOSIS_STROKE", "LAB", "VITAL_SIGNS", "NEURO_EXAM", "OUTCOME_LOS"]
TYPES = ["radiology", "lab", "resume", "cppt_igd", "cppt_ranap", "other"]


@query("P-19 P-20", f"""
WITH d AS (SELECT doc_id, {TYPES!r}[doc_id % 6 + 1] AS doc_type, ['lab','radiologi','cppt_igd','cppt_ranap','resume','unknown'][doc_id % 6 + 1] AS role FROM documents),
g AS (SELECT unnest({GROUPS!r}) AS grp),
a(doc_type, grp) AS (VALUES ('radiology','DIAGNOSIS_STROKE'),('lab','LAB'),('resume','DIAGNOSIS_STROKE'),('resume','LAB'),('resume','OUTCOME_LOS'),('resume','NEURO_EXAM'),
 ('cppt_igd','NEURO_EXAM'),('cppt_igd','VITAL_SIGNS'),('cppt_igd','DIAGNOSIS_STROKE'),('cppt_ranap','OUTCOME_LOS'),('cppt_ranap','NEURO_EXAM'))
SELECT d.doc_id, d.doc_type, g.grp AS keyword_group,
 d.role IN ('cppt_ranap','resume','unknown') AS do_klinis, d.role IN ('lab','unknown') AS do_lab
FROM d, g WHERE d.doc_type = 'other' OR EXISTS (SELECT 1 FROM a WHERE a.doc_type = d.doc_type AND a.grp = g.grp)""")
def allowed_groups(t: Tables):
    d = t.documents.select(
        "doc_id",
        F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("doc_id") % 6 + 1).cast("int")).alias("doc_type"),
        F.element_at(F.array(*[F.lit(x) for x in ["lab", "radiologi", "cppt_igd", "cppt_ranap", "resume", "unknown"]]), (F.col("doc_id") % 6 + 1).cast("int")).alias("role"),
        F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("keyword_group"),
    ).filter(C.group_allowed("keyword_group", "doc_type"))
    return d.select("doc_id", "doc_type", "keyword_group", C.routed("role", "klinis").alias("do_klinis"), C.routed("role", "lab").alias("do_lab"))


@query("P-24", """
SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_'), ''), 'pasien') AS stem,
 array_to_string(list_transform(list_filter(string_split_regex(url, '[\\\\/]+'), lambda p: trim(p) <> ''),
   lambda p: coalesce(nullif(trim(regexp_replace(p, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '_'), ''), 'pasien')), '/') AS path
FROM pages""")
def safe_names(t: Tables):
    return t.pages.select("page_id", T.safe_name("url").alias("stem"), T.safe_path("url").alias("path"))


# Values as an extractor would return them: numbers with comma or point, flags,
# sentinels, blanks.
def raw_values(t: Tables):
    k = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("long")
    value = (
        F.when(k % 9 == 0, "ada").when(k % 9 == 1, "tidak").when(k % 9 == 2, "").when(k % 9 == 3, "unknown")
        .when(k % 9 == 4, F.concat((price % 400).cast("string"), F.lit(","), (k % 10).cast("string")))
        .when(k % 9 == 5, F.concat((price % 50).cast("string"), F.lit(" mg")))
        .when(k % 9 == 6, F.concat(F.lit("ada ("), (k % 5).cast("string"), F.lit(")")))
        .otherwise((price % 300).cast("string"))
    )
    fields = F.array(*[F.lit(f) for f in ["gcs", "td_sistol", "hr", "suhu", "lab_hb", "lab_gds", "catatan"]])
    return t.orders.select(k.alias("record_id"), F.element_at(fields, (k % 7 + 1).cast("int")).alias("field"), value.alias("value"))


RAW_SQL = """(SELECT o_orderkey AS record_id, ['gcs','td_sistol','hr','suhu','lab_hb','lab_gds','catatan'][o_orderkey % 7 + 1] AS field,
 CASE o_orderkey % 9 WHEN 0 THEN 'ada' WHEN 1 THEN 'tidak' WHEN 2 THEN '' WHEN 3 THEN 'unknown'
  WHEN 4 THEN (CAST(floor(o_totalprice) AS BIGINT) % 400) || ',' || (o_orderkey % 10)
  WHEN 5 THEN (CAST(floor(o_totalprice) AS BIGINT) % 50) || ' mg' WHEN 6 THEN 'ada (' || (o_orderkey % 5) || ')'
  ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 300 AS VARCHAR) END AS value FROM orders)"""
LIMITS = "VALUES ('gcs',3,15),('td_sistol',60,260),('hr',30,250),('suhu',35,42),('lab_hb',2,25),('lab_gds',10,800)"


@query("P-13", f"""
SELECT record_id, field, categorical, CASE WHEN field <> 'catatan' THEN n END AS number,
 CASE WHEN categorical OR field = 'catatan' THEN v WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS value
FROM (SELECT record_id, field, v, v IN ('ada','tidak') OR starts_with(v,'ada') AS categorical, TRY_CAST(replace(v, ',', '.') AS DOUBLE) AS n
 FROM (SELECT record_id, field, nullif(nullif(value,'unknown'),'') AS v FROM {RAW_SQL}))""")
def coerce_types(t: Tables):
    """Numbers, categories, texts and missing values, of every record and field."""
    kinds = {f: "numeric" for f in ["gcs", "td_sistol", "hr", "suhu", "lab_hb", "lab_gds"]}
    r = raw_values(t).withColumn("value", T.missing_to_null("value"))
    flagged = r.withColumn("categorical", Rec.is_categorical(F.col("value")))
    return Rec.coerce(flagged, kinds).select("record_id", "field", "value", "number", "categorical")


@query("P-14 J-06", f"""
WITH r(field, lo, hi) AS ({LIMITS})
SELECT v.record_id, v.field, CASE WHEN n IS NOT NULL AND lo IS NOT NULL AND (n < lo OR n > hi) THEN 'invalid' ELSE value END AS value,
 n IS NOT NULL AND lo IS NOT NULL AND (n < lo OR n > hi) AS warned
FROM (SELECT *, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS n FROM {RAW_SQL}) v LEFT JOIN r ON r.field = v.field""")
def validate_ranges(t: Tables):
    return Rec.validate(raw_values(t)).select("record_id", "field", "value", F.col("warning").isNotNull().alias("warned"))


@query("A-18 P-14", f"""
WITH r(field, lo, hi) AS ({LIMITS})
SELECT v.field, count(*) AS n_invalid FROM (SELECT *, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS n FROM {RAW_SQL}) v JOIN r ON r.field = v.field
WHERE n < lo OR n > hi GROUP BY 1""")
def invalid_values(t: Tables):
    from ..operators.audit import invalid_counts

    return invalid_counts(Rec.validate(raw_values(t)))


@query("P-15", """
WITH e AS (SELECT event_id, CAST(40 + event_id % 260 AS VARCHAR) || '/' || CAST(20 + event_id % 190 AS VARCHAR) || ' mmHg' AS bp,
  CAST(5 + (event_id * 7) % 1000 AS VARCHAR) || ' mg/dL' AS gds,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 20 AS VARCHAR) ELSE 'E' || (event_id % 5) || 'V' || (event_id % 6) || 'M' || (event_id % 7) END AS gcs,
  40 + event_id % 260 AS s, 20 + event_id % 190 AS d, 5 + (event_id*7) % 1000 AS g FROM events)
SELECT event_id, CASE WHEN s BETWEEN 60 AND 260 AND d BETWEEN 30 AND 180 THEN s || '/' || d || ' mmHg' ELSE '' END AS bp,
 CASE WHEN g < 10 OR CAST(left(CAST(g AS VARCHAR), 4) AS INT) BETWEEN 20 AND 800 THEN gds ELSE '' END AS gds,
 CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 20 BETWEEN 3 AND 15 THEN gcs ELSE '' END
  ELSE CASE WHEN (event_id % 5) BETWEEN 3 AND 15 OR (event_id % 5) + (event_id % 6) + (event_id % 7) BETWEEN 3 AND 15 THEN gcs ELSE '' END END AS gcs
FROM e""")
def vital_checks(t: Tables):
    k = F.col("event_id")

    def s(c):
        return c.cast("string")

    raw = t.events.select(
        "event_id",
        F.concat(s(40 + k % 260), F.lit("/"), s(20 + k % 190), F.lit(" mmHg")).alias("bp"),
        F.concat(s(5 + (k * 7) % 1000), F.lit(" mg/dL")).alias("gds"),
        F.when(k % 2 == 0, s(k % 20)).otherwise(F.concat(F.lit("E"), s(k % 5), F.lit("V"), s(k % 6), F.lit("M"), s(k % 7))).alias("gcs"),
    )
    return raw.select(
        "event_id", Rec.check_blood_pressure("bp").alias("bp"), Rec.check_glucose("gds").alias("gds"), Rec.check_gcs("gcs").alias("gcs")
    )


@query("P-10 P-11 P-22", f"""
SELECT record_id, 'vital_' || f AS field, value FROM {RAW_SQL} r,
 LATERAL (SELECT unnest(CASE r.field WHEN 'gcs' THEN ['gcs','skor_gcs'] ELSE [r.field] END) AS f) x WHERE r.field IN ('gcs','hr','suhu')""")
def field_aliases(t: Tables):
    wanted = ["gcs", "hr", "suhu"]
    r = raw_values(t).filter(F.col("field").isin(*wanted)).withColumn("category", F.lit("Vital Sign"))
    aliased = Rec.with_aliases(r, {"skor_gcs": "gcs"})
    return Rec.prefixed(aliased, {"Vital Sign": "vital_"}).select("record_id", "field", "value")


@query("S-06", "SELECT doc_id, text FROM documents")
def decode_bytes(t: Tables):
    """Every document as bytes: UTF-8, or Latin-1 for every second one that has no other letters."""
    latin = (F.col("doc_id") % 2 == 1) & F.col("text").rlike(r"^[\x{00}-\x{FF}]*$")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", T.decode_bytes(raw).alias("text"))


@query("S-21", """
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE left(text, 30) END AS a, CASE WHEN turn % 2 = 0 THEN text ELSE NULL END AS b, text AS o FROM conversations),
n AS (SELECT *, length(regexp_replace(a,'\\s+','','g')) AS na, length(regexp_replace(coalesce(b,''),'\\s+','','g')) AS nb, length(regexp_replace(o,'\\s+','','g')) AS no FROM c)
SELECT conv_id, turn, CASE WHEN na >= 50 THEN a WHEN nb >= 50 THEN b ELSE o END AS text,
 CASE WHEN na >= 50 THEN 'pdf_pypdf' WHEN nb >= 50 THEN 'pdf_fitz_text' WHEN no >= 50 THEN 'pdf_ocr' ELSE 'pdf_empty_or_failed' END AS extraction_status FROM n""")
def text_source_fallback(t: Tables):
    x = F.col("text")
    chosen = T.choose_text(
        [
            ("pdf_pypdf", F.when(F.col("turn") % 3 == 0, x).otherwise(F.substring(x, 1, 30))),
            ("pdf_fitz_text", F.when(F.col("turn") % 2 == 0, x)),
            ("pdf_ocr", x),
        ]
    )
    return t.conversations.select("conv_id", "turn", chosen.alias("c")).select("conv_id", "turn", "c.*")


@query("E-28", """
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS iso_text, d AS parsed_day,
 CAST(date_diff('day', d - INTERVAL (o_orderkey % 11) DAY, d) AS INT) AS stay FROM d""")
def indonesian_dates(t: Tables):
    months = F.array(*[F.lit(m) for m in "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split()])
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))

    def written(day):
        return F.concat_ws(" ", F.day(day).cast("string"), F.element_at(months, F.month(day)), F.year(day).cast("string"))

    return d.select(
        "o_orderkey",
        T.parse_date_text(F.concat(F.lit("Tanggal: "), written(F.col("d")))).alias("iso_text"),
        T.parse_day_first_date(F.date_format("d", "d/M/yyyy")).alias("parsed_day"),
        Rec.stay_days(written(F.date_sub("d", (F.col("o_orderkey") % 11).cast("int"))), written(F.col("d"))).alias("stay"),
    )
