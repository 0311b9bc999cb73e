"""Records, merges, ordering, and the sinks' row shapes over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A, lines as Ln, merge as M, records as Rec
from ..skew import concat_parts, running_total
from .registry import Tables, query


def customer_record(t: Tables):
    """Long ``(patient_id, field, value)`` of customers, with missing values."""
    wide = t.customer.select(
        F.col("c_custkey").alias("patient_id"),
        F.col("c_mktsegment").alias("segmen"),
        F.when(F.col("c_nationkey") % 5 == 0, None).when(F.col("c_nationkey") % 5 == 1, "unknown").otherwise(F.concat(F.lit("N"), (F.col("c_nationkey") % 4).cast("string"))).alias("wilayah"),
        F.when(F.col("c_custkey") % 10 == 0, "invalid").otherwise(F.floor("c_acctbal").cast("long").cast("string")).alias("saldo"),
        F.when(F.col("c_custkey") % 3 == 0, "ada").when(F.col("c_custkey") % 3 == 1, "tidak").alias("ct_documented"),
    )
    return Rec.to_long(wide, ["patient_id"], ["segmen", "wilayah", "saldo", "ct_documented"])


REC = """r AS (
 SELECT c_custkey AS patient_id, 'segmen' AS field, c_mktsegment AS value FROM customer
 UNION ALL SELECT c_custkey, 'wilayah', CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'N' || (c_nationkey % 4) END FROM customer
 UNION ALL SELECT c_custkey, 'saldo', CASE WHEN c_custkey % 10 = 0 THEN 'invalid' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END FROM customer
 UNION ALL SELECT c_custkey, 'ct_documented', CASE c_custkey % 3 WHEN 0 THEN 'ada' WHEN 1 THEN 'tidak' END FROM customer)"""


@query("A-14", f"""WITH {REC}, f AS (SELECT field, value, count(*) AS n FROM r WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT field, value, n FROM f WHERE field IN (SELECT field FROM f GROUP BY 1 HAVING count(*) <= 5)""")
def value_counts(t: Tables):
    return A.value_counts(customer_record(t))


@query("A-15", f"""WITH {REC} SELECT count(*) AS cells, count(*) FILTER (value IS NULL OR value = 'unknown') AS unknown_cells,
 100.0 * CAST(count(*) FILTER (value IS NULL OR value = 'unknown') AS DOUBLE) / count(*) AS unknown_pct FROM r""")
def unknown_share(t: Tables):
    return A.unknown_share(customer_record(t))


@query("A-16", f"""WITH {REC}, n AS (SELECT field, TRY_CAST(value AS BIGINT) AS v FROM r)
SELECT field, count(v) AS n, CAST(sum(v) AS DOUBLE) / count(v) AS mean, CAST(min(v) AS DOUBLE) AS min, CAST(max(v) AS DOUBLE) AS max FROM n GROUP BY 1""")
def numeric_stats(t: Tables):
    return A.numeric_stats(customer_record(t))


@query("A-17", f"""WITH {REC} SELECT field, count(*) FILTER (value = 'ada') AS n, count(*) AS total, 100.0 * CAST(count(*) FILTER (value = 'ada') AS DOUBLE) / count(*) AS pct FROM r GROUP BY 1""")
def category_share(t: Tables):
    return A.category_share(customer_record(t), ["ada"])


@query("A-18", f"""WITH {REC} SELECT field, count(*) AS n_invalid FROM r WHERE value = 'invalid' GROUP BY 1""")
def invalid_counts(t: Tables):
    return A.invalid_counts(customer_record(t))


@query("E-49 P-21", """SELECT c_custkey AS patient_id, c_mktsegment AS segmen,
 CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'N' || (c_nationkey % 4) END AS wilayah FROM customer""")
def wide_record(t: Tables):
    return Rec.to_wide(customer_record(t), "patient_id", ["segmen", "wilayah"])


@query("A-22", """
WITH s AS (SELECT source, count(*) FILTER (lang = 'en') AS en, max(CASE WHEN n_chars > 20000 THEN 'panjang' END) AS long_doc FROM documents GROUP BY 1)
SELECT source, 'Dokumen Inggris tercatat' AS item, 'Terpenuhi' AS status, CAST(en AS VARCHAR) AS note FROM s
UNION ALL SELECT source, 'Dokumen panjang tercatat', CASE WHEN long_doc IS NULL THEN 'Belum ditemukan' ELSE 'Terpenuhi' END, coalesce(long_doc, '') FROM s""")
def documentation_audit(t: Tables):
    wide = t.documents.groupBy("source").agg(
        F.count_if(F.col("lang") == "en").cast("string").alias("en"), F.max(F.when(F.col("n_chars") > 20000, "panjang")).alias("long_doc")
    )
    return A.documentation_audit(wide, ["source"], [("Dokumen Inggris tercatat", "en"), ("Dokumen panjang tercatat", "long_doc")])


@query("A-21", "SELECT o_orderstatus AS stroke_type, count(*) AS n FROM orders GROUP BY 1")
def subtype_counts(t: Tables):
    return A.type_counts(t.orders.withColumnRenamed("o_orderstatus", "stroke_type"), "stroke_type")


@query("A-26", """
WITH d AS (SELECT conv_id AS patient_id, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars, sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS solid,
 count(*) FILTER (role = 'system') AS n_ocr, CAST(sum(len(regexp_extract_all(text, '\\d'))) AS BIGINT) AS n_digits FROM conversations GROUP BY 1)
SELECT patient_id, CASE WHEN solid < 50 THEN 'Perlu OCR manual' WHEN n_ocr > 0 THEN 'Selesai (OCR)' ELSE 'Selesai' END AS status, n_files, n_chars, n_ocr,
 CASE WHEN n_digits > 0 THEN '{"digit":' || n_digits || '}' ELSE '{}' END AS masking FROM d""")
def extraction_log(t: Tables):
    from ..operators.redact import apply_rules
    from ..rules import Rule

    d = t.conversations.select(F.col("conv_id").alias("patient_id"), "text", (F.col("role") == "system").alias("ocr_used"))
    # same length: a digit is masked by one character
    return A.extraction_log(apply_rules(d, [Rule("digit", r"\d", "#", "")]))


# ---------------------------------------------------------------------------
# Merging and ordering
# ---------------------------------------------------------------------------
@query("U-01 U-02 W-03", """
WITH b AS (SELECT o_custkey AS patient_id, o_orderkey, o_orderstatus AS status, NULL AS prioritas, 1 AS batch FROM orders WHERE o_orderkey % 3 <> 0
 UNION ALL SELECT o_custkey, o_orderkey, NULL, o_orderpriority, 2 FROM orders WHERE o_orderkey % 3 = 0)
SELECT patient_id, o_orderkey, status, prioritas, batch FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY batch DESC, o_orderkey DESC) AS rn FROM b) WHERE rn = 1""")
def merge_keep_last(t: Tables):
    key = F.col("o_custkey").alias("patient_id")
    old = t.orders.filter(F.col("o_orderkey") % 3 != 0).select(key, "o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("batch"))
    new = t.orders.filter(F.col("o_orderkey") % 3 == 0).select(key, "o_orderkey", F.col("o_orderpriority").alias("prioritas"), F.lit(2).alias("batch"))
    return M.merge_batches(old, new, ["patient_id"], ["batch", "o_orderkey"])


@query("W-02", """
SELECT doc_id, source, source || CASE WHEN rn > 1 THEN '_' || rn ELSE '' END AS numbered FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""")
def number_duplicates(t: Tables):
    return M.number_duplicates(t.documents.select("doc_id", "source"), "source", "doc_id", span=256).select("doc_id", "source", "numbered")


@query("W-04", """
SELECT text, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def keep_first(t: Tables):
    return M.keep_first(t.documents.select("text", "doc_id", "lang"), ["text"], ["doc_id"])


@query("W-08 E-48", """
WITH u AS (SELECT source, doc_id, text, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents)
SELECT source, doc_id, CAST(used AS BIGINT) AS used, left(text, CAST(8000 - (used - length(text) - 1) AS BIGINT)) AS text FROM u WHERE used - length(text) - 1 < 8000""")
def budget_prefix(t: Tables):
    return Ln.budget_prefix(t.documents.select("source", "doc_id", "text"), ["source"], "doc_id", "text")


@query("W-08", """
SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM documents""")
def running_chars(t: Tables):
    return running_total(t.documents.select("source", "doc_id", "n_chars"), ["source"], "doc_id", F.col("n_chars"), span=128).select("source", "doc_id", "running")


@query("S-14", """
SELECT source, lang, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_parts, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text, count(*) AS n_items FROM documents GROUP BY 1, 2""")
def concat_by_type(t: Tables):
    return concat_parts(t.documents, ["source", "lang"], "doc_id", F.col("text"), "\n\n")


@query("S-20", """
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_parts, string_agg(chr(10) || '--- HALAMAN ' || (turn + 1) || ': ' || conv_id || ' ---' || chr(10) || text, chr(10) ORDER BY turn) AS text, count(*) AS n_items
FROM conversations GROUP BY 1""")
def page_assembly(t: Tables):
    page = F.concat(F.lit("\n--- HALAMAN "), (F.col("turn") + 1).cast("string"), F.lit(": "), F.col("conv_id").cast("string"), F.lit(" ---\n"), F.col("text"))
    return concat_parts(t.conversations, ["conv_id"], "turn", page, "\n")


@query("S-24", """
SELECT source, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_parts, string_agg(chr(10) || chr(10) || '===== SUMBER FILE: ' || doc_id || '.txt =====' || chr(10) || trim(text), chr(10) ORDER BY doc_id) AS text, count(*) AS n_items
FROM documents WHERE trim(text) <> '' GROUP BY 1""")
def source_tagged_text(t: Tables):
    d = t.documents.withColumn("text", F.trim("text")).filter(F.col("text") != "")
    tagged = F.concat(F.lit("\n\n===== SUMBER FILE: "), F.col("doc_id").cast("string"), F.lit(".txt =====\n"), F.col("text"))
    return concat_parts(d, ["source"], "doc_id", tagged, "\n")


# ---------------------------------------------------------------------------
# Folder keys, staff, drugs, logs
# ---------------------------------------------------------------------------
@query("S-02 S-04", """
WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS rel FROM pages)
SELECT page_id, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE 'akar' END AS patient_id, rel AS source_file FROM p""")
def path_keys(t: Tables):
    from ..sources.documents import with_path_keys

    d = t.pages.select("page_id", F.regexp_replace("url", "^https?://[^/]+/", "").alias("path"))
    return with_path_keys(d, "path", root="akar").select("page_id", "patient_id", "source_file")


@query("S-03", """
WITH l AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 AND length(source) % 2 = 0 THEN source ELSE source || '/' || lang END AS leaf, source AS top FROM documents),
g AS (SELECT top, count(*) AS n, bool_or(leaf = top) AS holds FROM l GROUP BY 1)
SELECT DISTINCT CASE WHEN holds OR n = 1 THEN g.top ELSE leaf END AS patient_folder FROM l JOIN g ON g.top = l.top""")
def patient_folders(t: Tables):
    from ..sources.documents import discover_patients

    top = (F.col("doc_id") % 7 == 0) & (F.length("source") % 2 == 0)
    leaf = F.when(top, F.col("source")).otherwise(F.concat_ws("/", "source", "lang"))
    return discover_patients(t.documents.select(leaf.alias("folder")), "folder")


@query("S-05 J-07", """
SELECT doc_id, f AS source_file FROM (SELECT doc_id, lang || '_' || doc_id || ['', '_anonim', '_ekstrak', ''][doc_id % 4 + 1] || '.txt' AS f FROM documents) d
WHERE doc_id % 4 IN (0, 3) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def skip_processed(t: Tables):
    suffix = F.element_at(F.array(F.lit(""), F.lit("_anonim"), F.lit("_ekstrak"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    d = t.documents.select("doc_id", F.concat(F.concat_ws("_", "lang", F.col("doc_id").cast("string")), suffix, F.lit(".txt")).alias("source_file"))
    done = t.labels.join(d, "doc_id").select("source_file")
    return M.skip_processed(d, done, "source_file")


@query("S-08", """
WITH d(drug_key, term_pos, term) AS (VALUES ('med_a',0,'baru'),('med_b',0,'lama'),('med_c',0,'tambahan'))
SELECT p_partkey, d.drug_key, d.term FROM part, d WHERE p_partkey % 3 = CASE d.drug_key WHEN 'med_a' THEN 0 WHEN 'med_b' THEN 1 ELSE 2 END""")
def drug_dictionary(t: Tables):
    """User lists over default lists, joined with the rows that use a class."""
    from ..session import broadcast_if_small
    from ..sources.profiles import drug_frame, merge_drugs

    drugs = merge_drugs({"med_a": ["asal"], "med_b": ["lama"]}, {"_note": "x", "med_a": ["baru"], "med_b": [], "med_c": ["tambahan"]})
    used = t.part.select("p_partkey", F.element_at(F.array(F.lit("med_a"), F.lit("med_b"), F.lit("med_c")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("drug_key"))
    return used.join(broadcast_if_small(drug_frame(t.spark, drugs)), "drug_key").select("p_partkey", "drug_key", "term")


@query("S-19", """
SELECT event_id, ts_text FROM (SELECT event_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS ts_text, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS rn,
 EXISTS (SELECT 1 FROM events o WHERE o.event_id % 97 = 0 AND date_trunc('hour', o.ts) = date_trunc('hour', events.ts)) AS logged FROM events WHERE event_id % 97 <> 0) WHERE rn = 1 AND NOT logged""")
def append_log(t: Tables):
    e = t.events.select("event_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("ts_text"))
    first = M.keep_first(e.filter(F.col("event_id") % 97 != 0), ["ts_text"], ["event_id"]).select("event_id", "ts_text")
    return M.append_new(e.filter(F.col("event_id") % 97 == 0), first, ["ts_text"])


@query("E-50 J-07", """
WITH r AS (SELECT c_custkey AS patient_id FROM customer), d AS (SELECT conv_id AS patient_id, bool_or(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 20) AS ok FROM conversations GROUP BY 1)
SELECT r.patient_id, CASE WHEN ok IS NULL THEN 'folder_not_found' ELSE 'no_valid_files' END AS error FROM r LEFT JOIN d ON d.patient_id = r.patient_id WHERE ok IS NULL OR NOT ok""")
def error_rows(t: Tables):
    requested = t.customer.select(F.col("c_custkey").alias("patient_id"))
    return Rec.error_rows(requested, t.conversations.withColumnRenamed("conv_id", "patient_id"))


@query("S-23 S-17", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events""")
def fenced_answers(t: Tables):
    from ..sources.documents import parse_answer

    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("kind")))
    wrapped = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Jawaban: "), body, F.lit(" selesai.")))
        .otherwise(body)
    )
    return t.events.select("event_id", parse_answer(wrapped, "k long, kind string").alias("a")).select("event_id", "a.*")


@query("U-06", """
SELECT l_returnflag, l_linestatus, array_to_string(list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))), ', ') AS line_numbers FROM lineitem GROUP BY 1, 2""")
def sorted_sets(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ", ").alias("line_numbers")
    )
