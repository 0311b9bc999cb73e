"""Whole runs over the tables: failing documents, results with an index, audits with
the columns that the data has, large dictionaries, later categories, several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E, isolate as S, redact as X
from ..operators.profile_run import run_profile
from ..rules import Rule
from ..sources import results as W
from ..sources.profiles import Category, Profile
from ..streaming import incremental as I
from .extraction_queries import DRUGS, _drug_sql
from .registry import Tables, query
from .stream_queries import scratch

# One planted fault for each kind: bytes that are not UTF-8, a JSON file cut short, a
# field of another type, a visit date that does not exist.
FAULT = "CASE doc_id % 11 WHEN 3 THEN 'unreadable bytes' WHEN 5 THEN 'broken JSON' WHEN 7 THEN 'broken JSON' WHEN 9 THEN 'no such date' ELSE '' END"
# Letters of either case, with the two that Unicode folds to k and s (no others).
ADDRESS = r"[A-Za-z0-9.\x{17F}\x{212A}]+"
RULES = [Rule("mail", f"{ADDRESS}@{ADDRESS}", "[SUREL]", ""), Rule("digits", r"\d+", "[ANGKA]", "")]
SCHEMA = "text string, visit string, pages int"


def raw_files(t: Tables):
    """Documents as JSON files in bytes, some of them broken."""
    kind = F.col("doc_id") % 11
    visit = F.when(kind == 9, "31/02/2026").otherwise("03/05/2026")
    body = F.to_json(F.struct("text", visit.alias("visit"), F.lit(1).alias("pages")))
    body = F.when(kind == 5, F.substring(body, F.lit(1), F.length(body) - 4)).when(kind == 7, F.replace(body, F.lit('"pages":1'), F.lit('"pages":"satu"'))).otherwise(body)
    raw = F.encode(body, "UTF-8")
    content = F.when(kind == 3, F.concat(F.unhex(F.lit("FF81C3")), raw)).otherwise(raw)
    return t.spread("documents").select("doc_id", F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("source_file"), content.alias("content"))


def isolated_run(t: Tables):
    """Read, parse and redact; a failing document stays as an error row."""
    steps = [
        S.Step("raw", lambda: S.strict_text("content"), "unreadable bytes"),
        S.Step("body", lambda: S.strict_json("raw", SCHEMA), "broken JSON"),
        S.Step("visit", lambda: F.try_to_date(F.col("body.visit"), "dd/MM/yyyy"), "no such date"),
    ]
    read = S.run_steps(raw_files(t), steps).withColumn("text", F.coalesce(F.when(F.col("error").isNull(), F.col("body.text")), F.lit("")))
    sized = read.select("doc_id", "source_file", "error", "text", F.length("text").alias("size"))
    return X.apply_rules(sized, RULES)


@query("S-22 S-06", f"""
WITH f AS (SELECT doc_id, text, {FAULT} AS error FROM documents),
m AS (SELECT *, regexp_replace(text, '(?i)[a-z0-9.]+@[a-z0-9.]+', '[SUREL]', 'g') AS t1 FROM f)
SELECT 'a/' || doc_id || '.json' AS source_file, CASE WHEN error <> '' THEN '' ELSE 'a/' || doc_id || '.anon.txt' END AS output_file,
 CASE WHEN error <> '' THEN 'error' ELSE 'text' END AS extraction_status, error,
 CASE WHEN error <> '' THEN 0 ELSE length(text) END AS chars_in,
 CASE WHEN error <> '' THEN 0 ELSE length(regexp_replace(t1, '\\d+', '[ANGKA]', 'g')) END AS chars_out,
 error <> '' AS needs_manual_review, CASE WHEN error <> '' THEN 0 ELSE len(regexp_extract_all(t1, '\\d+')) END AS n_digits,
 CASE WHEN error <> '' THEN 0 ELSE len(regexp_extract_all(text, '(?i)[a-z0-9.]+@[a-z0-9.]+')) END AS n_mail FROM m""")
def isolated_documents(t: Tables):
    """One audit row for every file, failing ones included."""
    rows = S.result_rows(isolated_run(t), chars_in=F.col("size"))
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return rows.select("source_file", "output_file", "extraction_status", "error", "chars_in", "chars_out", "needs_manual_review", n("digits"), n("mail"))


@query("S-15 U-07", f"""
WITH f AS (SELECT doc_id, text, {FAULT} AS error FROM documents), m AS (SELECT *, regexp_replace(text, '(?i)[a-z0-9.]+@[a-z0-9.]+', '[SUREL]', 'g') AS t1 FROM f)
SELECT 'a/' || doc_id || '.json' AS source_file, CASE WHEN error <> '' THEN '0' ELSE CAST(len(regexp_extract_all(t1, '\\d+')) AS VARCHAR) END AS digits,
 CASE WHEN error <> '' THEN '0' ELSE CAST(len(regexp_extract_all(text, '(?i)[a-z0-9.]+@[a-z0-9.]+')) AS VARCHAR) END AS mail,
 CASE WHEN error <> '' THEN 'true' ELSE 'false' END AS needs_manual_review FROM m""")
def audit_csv(t: Tables):
    """The audit written as CSV with the count keys that the data has, and read back by its header."""
    out = scratch(t, "audit-csv")
    columns = W.write_audit_csv(S.result_rows(isolated_run(t), chars_in=F.col("size")), out)
    back = t.spark.read.option("header", True).csv(out)
    assert back.columns == columns
    return back.select("source_file", "digits", "mail", "needs_manual_review")


@query("S-17 S-22", f"""
WITH f AS (SELECT doc_id, lang, text, {FAULT} AS error FROM documents)
SELECT CASE WHEN lang = 'en' THEN 'run-2' ELSE 'run-1' END AS run_id, 'a/' || doc_id || '.json' AS source_file, CASE WHEN error <> '' THEN 'error' ELSE 'ok' END AS status, error,
 error = '' AS has_file, CASE WHEN error = '' THEN length(regexp_replace(regexp_replace(text, '(?i)[a-z0-9.]+@[a-z0-9.]+', '[SUREL]', 'g'), '\\d+', '[ANGKA]', 'g')) END AS n_chars FROM f""")
def results_index(t: Tables):
    """Two runs of one folder, the first written twice; index and data read back together."""
    out = scratch(t, "results")
    run = isolated_run(t).select("doc_id", "source_file", "error", "text")
    english = t.documents.select("doc_id", (F.col("lang") == "en").alias("en"))
    both = run.join(english, "doc_id").drop("doc_id")
    for name, part in (("run-1", both.filter("NOT en")), ("run-2", both.filter("en")), ("run-1", both.filter("NOT en"))):
        W.write_results(part.drop("en"), out, name, "source_file")
    data = W.read_results(t.spark, out, "source_file string, text string").select("run_id", "source_file", F.length("text").cast("long").alias("n_chars"))
    index = W.read_index(t.spark, out)
    return index.join(data, ["run_id", "source_file"], "left").select("run_id", "source_file", "status", "error", (F.col("file") != "").alias("has_file"), "n_chars")


@query("E-20 E-21 E-22", _drug_sql())
def large_drug_dictionary(t: Tables):
    """The dictionary joined by n-grams instead of compiled: the same rows."""
    d = t.spread("documents").select(
        F.col("source").alias("patient_id"), "doc_id", F.replace("text", F.lit("hein "), F.lit("hein 500mg/8 jam selama 7 hari ")).alias("text")
    )
    return E.medications(d, DRUGS, order="doc_id", max_terms=1)


MATCH_SQL = """
WITH c AS (SELECT doc_id, label, nth, hit, pieces, text FROM (
 SELECT doc_id, text, 'SUREL' AS label, unnest(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) AS hit,
  generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+'), 1) AS nth, string_split_regex(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') AS pieces FROM documents
 UNION ALL SELECT doc_id, text, 'ANGKA', unnest(regexp_extract_all(text, '[0-9]{2,}')), generate_subscripts(regexp_extract_all(text, '[0-9]{2,}'), 1), string_split_regex(text, '[0-9]{2,}') FROM documents)),
p AS (SELECT *, CAST(sum(length(pieces[nth]) + length(hit)) OVER (PARTITION BY doc_id, label ORDER BY nth) - length(hit) AS BIGINT) AS start FROM c),
x AS (SELECT *, greatest(start - 30, 0) AS a, least(start + length(hit) + 30, length(text)) AS b FROM p)
SELECT doc_id, label, CAST(nth AS INTEGER) AS nth, CAST(start AS INTEGER) AS start, hit, trim(regexp_replace(substring(text, a + 1, b - a), '\\s+', ' ', 'g')) AS context FROM x"""


@query("E-37 P-04", MATCH_SQL)
def labelled_matches(t: Tables):
    """Every match of two labelled patterns with its offset and context."""
    rules = {"SUREL": r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "ANGKA": r"[0-9]{2,}"}
    return E.labelled_matches(t.spread("documents").select("doc_id", "text"), rules, ["doc_id"], radius=30)


@query("E-49 E-01 E-02 U-03", """
SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '10' END AS nilai, CASE WHEN c_custkey % 3 = 0 THEN 'ada' END AS demam,
 '10' AS awal FROM customer""")
def later_category(t: Tables):
    """Fields of several categories: the later one that found a value wins, not the greater
    text; regex with DOTALL, two regex categories and keywords in one run."""
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("Skor: 10\nTEKS\nKesimpulan\n"), F.when(k % 2 == 0, "Ulang: 9").otherwise("polos"), F.lit("\nakhir. "), F.when(k % 3 == 0, "pasien demam tinggi").otherwise("pasien baik")
    )
    docs = t.customer.select(k.alias("patient_id"), F.lit("resume.txt").alias("source_file"), F.lit("resume").alias("doc_type"), text.alias("text"))
    profile = Profile(
        "Uji",
        [
            Category("Awal", "regex", ["nilai", "awal"], regex=[E.FieldRule("nilai", r"Skor:\s*(\d+)"), E.FieldRule("awal", r"Skor:\s*(\d+)")]),
            Category("Ulang", "regex", ["nilai"], regex=[E.FieldRule("nilai", r"TEKS.*Ulang:\s*(\d+)", (), True)]),
            Category("Gejala", "keyword", ["demam"], keywords=[E.KeywordRule("demam", ("demam",))]),
        ],
    )
    wide = run_profile(docs, profile, wide=True)
    return wide.select("patient_id", "nilai", "demam", "awal")


@query("T-01 T-02 U-01 W-03", """
WITH b AS (SELECT doc_id, text, lang, CASE WHEN lang = 'en' THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM documents)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, regexp_replace(text, '\\d+', '[ANGKA]', 'g') AS text, CASE WHEN batch = 2 THEN lang END AS lang FROM b""")
def several_batches(t: Tables):
    """A folder that grows: three runs, the last with a new column, and a replay of the
    second batch that changes nothing."""
    out, arrivals = scratch(t, "batches"), scratch(t, "arrivals")
    batch = F.when(F.col("lang") == "en", 0).when(F.col("doc_id") % 2 == 0, 1).otherwise(2)
    docs = t.spread("documents").select("doc_id", "text", "lang", batch.alias("b"))
    schema = docs.select("doc_id", "text", "lang").schema
    redact = lambda d: X.apply_rules(d, RULES[1:])
    for n in range(3):
        new = docs.filter(F.col("b") == n).select("doc_id", "text", *(["lang"] if n == 2 else []))
        new.write.mode("append").parquet(arrivals)
        stream = I.read_new_files(t.spark, arrivals, schema)
        I.redact_new(stream, redact, out, out + "/_state", ["doc_id"])
    again = docs.filter(F.col("b") == 1).select("doc_id", "text", F.lit(None).cast("string").alias("lang")).withColumn("chars_in", F.length("text"))
    redact(again).withColumn("chars_out", F.length("text")).write.mode("overwrite").parquet(f"{out}/redacted/batch_id=1")
    return I.latest_rows(t.spark, f"{out}/redacted", ["doc_id"], []).select("doc_id", F.col("batch_id").cast("long").alias("batch"), "text", "lang")
