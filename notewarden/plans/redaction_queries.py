"""Redaction, leftovers, leaks and line review."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as T
from ..operators import audit as A, leaks as L, names as N, redact as X
from ..rules import Rule
from .registry import Tables, query

# ---------------------------------------------------------------------------
# General identifiers on the documents as given
# ---------------------------------------------------------------------------
EMAIL = R.EMAIL
DIGITS = R.DIGITS_16
PHONE = R.GENERAL_RULES[2].pattern
IP = R.GENERAL_RULES[3].pattern


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace_chain(x: str, rules) -> str:
    for r in rules:
        x = f"regexp_replace({x}, {lit(r.pattern)}, {lit(r.replacement)}, 'gi')"
    return x


def _count_chain() -> str:
    parts, x = [], "text"
    for r in R.GENERAL_RULES:
        parts.append(f"CAST(len(regexp_extract_all({x}, {lit('(?i)' + r.pattern)})) AS BIGINT) AS n_{r.key}")
        x = f"regexp_replace({x}, {lit(r.pattern)}, {lit(r.replacement)}, 'gi')"
    return ", ".join(parts)


@query("X-01 X-02", f"SELECT doc_id, {_replace_chain('text', R.GENERAL_RULES)} AS text FROM documents")
def redact_pii(t: Tables):
    return X.apply_rules(t.spread("documents").select("doc_id", "text"), R.GENERAL_RULES).select("doc_id", "text")


KINDS = [r.key for r in R.GENERAL_RULES]


@query("X-01 X-24 A-24", f"""
WITH c AS (SELECT {_count_chain()} FROM documents), u AS (
 {" UNION ALL ".join(f"SELECT '{k}' AS key, n_{k} AS n FROM c" for k in KINDS)})
SELECT key, count(*) AS files, CAST(sum(n) AS BIGINT) AS total FROM u WHERE n > 0 GROUP BY key""")
def redact_counts(t: Tables):
    return A.totals_by_key(X.apply_rules(t.spread("documents").select("doc_id", "text"), R.GENERAL_RULES))


@query("A-24", f"""
WITH c AS (SELECT {_count_chain()} FROM documents), s AS (SELECT {" + ".join(f"n_{k}" for k in KINDS)} AS n FROM c)
SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS total, sum(n) / count(*) AS mean, min(n) AS min, max(n) AS max FROM s""")
def redact_summary(t: Tables):
    return A.replacement_stats(X.apply_rules(t.spread("documents").select("doc_id", "text"), R.GENERAL_RULES))


@query("S-15 U-07 X-24", f"SELECT doc_id, source, length(text) AS chars_in, {_count_chain()} FROM documents")
def audit_report(t: Tables):
    d = X.apply_rules(t.spread("documents").withColumn("chars_in", F.length("text").cast("long")).select("doc_id", "source", "chars_in", "text"), R.GENERAL_RULES)
    wide = A.wide_counts(d, ["doc_id", "source", "chars_in"], KINDS)
    return wide.select("doc_id", "source", "chars_in", *[F.col(k).cast("long").alias(f"n_{k}") for k in KINDS])


@query("X-24", f"""
WITH c AS (SELECT source, {_count_chain()} FROM documents)
SELECT source, {", ".join(f"CAST(sum(n_{k}) AS BIGINT) AS n_{k}" for k in KINDS)} FROM c GROUP BY source""")
def merged_counts(t: Tables):
    d = X.apply_rules(t.spread("documents").select("source", "text"), R.GENERAL_RULES)
    rows = A.count_rows(d, keys=["source"]).groupBy("source", "key").agg(F.sum("n").alias("n"))
    per = d.select("source").distinct().join(rows, "source", "left").groupBy("source").pivot("key", KINDS).agg(F.sum("n"))
    return per.select("source", *[F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in KINDS])


LEFT = {r.key: r.pattern for r in R.LEFTOVER_RULES}
LEFT_SQL = {k: f"regexp_extract_all(text, {lit('(?i)' + p)})" for k, p in LEFT.items()}


@query("X-27 X-30 A-19 P-18", f"""
SELECT doc_id, {", ".join(f"CAST(len({LEFT_SQL[k]}) AS BIGINT) AS {k}" for k in LEFT)},
 {" + ".join(f"len({LEFT_SQL[k]})" for k in LEFT)} > 0 AS needs_manual_review FROM documents""")
def leftover_scan(t: Tables):
    d = X.scan_leftovers(t.spread("documents").select("doc_id", "text"))
    return d.select(
        "doc_id",
        *[F.coalesce(F.try_element_at("leftovers", F.lit(k)), F.lit(0)).cast("long").alias(k) for k in LEFT],
        A.any_positive("leftovers").alias("needs_manual_review"),
    )


@query("A-25 X-27", f"""
WITH u AS ({" UNION ALL ".join(f"SELECT '{k}' AS key, len({LEFT_SQL[k]}) AS n FROM documents" for k in LEFT)})
SELECT key, count(*) AS files, CAST(sum(n) AS BIGINT) AS total FROM u WHERE n > 0 GROUP BY key""")
def leftover_table(t: Tables):
    return A.totals_by_key(X.scan_leftovers(t.spread("documents").select("text")), "leftovers")


@query("X-29 W-07", f"""
SELECT doc_id, list_transform(list_slice({LEFT_SQL['leftover_email']}, 1, 3), lambda h: left(sha256(replace(trim(h), chr(10), ' ')), 16)) AS email_hashes,
 list_transform(list_slice({LEFT_SQL['leftover_nik_16']}, 1, 3), lambda h: left(sha256(h), 16)) AS nik_hashes
FROM documents WHERE len({LEFT_SQL['leftover_email']}) + len({LEFT_SQL['leftover_nik_16']}) > 0""")
def hashed_examples(t: Tables):
    rules = [r for r in R.LEFTOVER_RULES if r.key in ("leftover_email", "leftover_nik_16")]
    d = X.scan_leftovers(t.spread("documents").select("doc_id", "text"), rules).filter("needs_manual_review")
    none = F.array().cast("array<string>")
    return d.select(
        "doc_id",
        F.coalesce(F.try_element_at("leftover_examples", F.lit("leftover_email")), none).alias("email_hashes"),
        F.coalesce(F.try_element_at("leftover_examples", F.lit("leftover_nik_16")), none).alias("nik_hashes"),
    )


@query("P-23 X-30 P-17", f"""
SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN 'ERROR' WHEN len(regexp_extract_all(text, {lit(EMAIL)})) + len(regexp_extract_all(text, {lit(DIGITS)})) > 0
 OR regexp_matches(text, {lit(PHONE)}) THEN 'PERLU_REVIEW' ELSE 'AMAN' END AS status
FROM conversations WHERE contains(lower(role), 'us')""")
def review_status(t: Tables):
    from ..operators.records import review_status as status

    rules = [R.GENERAL_RULES[0], R.GENERAL_RULES[1], R.GENERAL_RULES[2]]
    d = X.scan_leftovers(t.conversations.filter(F.col("role").ilike("%us%")), rules)
    return d.select("conv_id", "turn", status(F.length("text") < 20, "needs_manual_review").alias("status"))


@query("A-19", f"""
SELECT count(*) AS files, count(*) FILTER (s = 'AMAN') AS safe, count(*) FILTER (s = 'PERLU_REVIEW') AS review, count(*) FILTER (s = 'ERROR') AS error,
 count(DISTINCT source) AS patients FROM (SELECT source, CASE WHEN length(text) < 200 THEN 'ERROR'
  WHEN regexp_matches(text, {lit(EMAIL)}) OR regexp_matches(text, {lit(DIGITS)}) THEN 'PERLU_REVIEW' ELSE 'AMAN' END AS s FROM documents)""")
def audit_totals(t: Tables):
    from ..operators.records import review_status as status

    d = X.scan_leftovers(t.spread("documents").select("source", "text"), [R.GENERAL_RULES[0], R.GENERAL_RULES[1]])
    return A.audit_totals(d.select("source", status(F.length("text") < 200, "needs_manual_review").alias("status")), patient="source")


def _leak_sql() -> str:
    parts = [
        f"SELECT doc_id, '{r.key}' AS category, unnest(regexp_extract_all(text, {lit('(?i)' + r.pattern)})) AS h FROM ascii_docs" for r in R.LEAK_RULES
    ]
    return f"""WITH ascii_docs AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM documents)
      SELECT doc_id, category, e AS evidence FROM (SELECT doc_id, category, left(trim(regexp_replace(h, '[ \\t]+', ' ', 'g')), 120) AS e
      FROM ({" UNION ALL ".join(parts)})) WHERE NOT regexp_matches(e, '\\[.+?\\]')"""


def ascii_documents(t: Tables):
    """Whole texts with letters outside ASCII written as 'x': word boundaries
    then mean the same in both engines."""
    return t.spread("documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))


@query("X-31", _leak_sql())
def leak_findings(t: Tables):
    return L.find_leaks(ascii_documents(t), ["doc_id"])


@query("A-20 X-31", f"SELECT category AS type, count(*) AS n FROM ({_leak_sql()}) GROUP BY 1")
def finding_counts(t: Tables):
    d = L.find_leaks(ascii_documents(t), ["doc_id"])
    return L.finding_counts(d.withColumnRenamed("category", "type"))


@query("A-20 W-07", f"SELECT evidence AS value, count(*) AS n FROM ({_leak_sql()}) GROUP BY 1 ORDER BY n DESC, value LIMIT 100")
def top_leak_values(t: Tables):
    d = L.find_leaks(ascii_documents(t), ["doc_id"])
    return L.top_values(d.withColumnRenamed("evidence", "value"))


@query("X-32 P-05", """
WITH p AS (SELECT doc_id, text, string_split(text, '@') AS parts FROM documents WHERE contains(text, '@')),
h AS (SELECT doc_id, text, unnest(range(1, len(parts))) AS i, parts FROM p),
s AS (SELECT doc_id, text, CAST(list_sum(list_transform(list_slice(parts, 1, i), lambda x: length(x))) AS BIGINT) + i - 1 AS s, length(text) AS n FROM h)
SELECT doc_id, 'at_sign' AS category, (CASE WHEN s > 40 THEN '…' ELSE '' END) ||
 trim(regexp_replace(replace(substring(text, greatest(s-40,0)+1, least(s+41,n)-greatest(s-40,0)), chr(10), ' '), '\\s{2,}', ' ', 'g')) ||
 (CASE WHEN s + 41 < n THEN '…' ELSE '' END) AS context FROM s""")
def leak_snippets(t: Tables):
    return L.leak_snippets(t.spread("documents").select("doc_id", "text"), ["doc_id"], [Rule("at_sign", "@")])


def _not_name(c: str) -> str:
    strip = f"regexp_replace({c}, '^[ ,.:;\\-()\\[\\]]+|[ ,.:;\\-()\\[\\]]+$', '', 'g')"
    known, short = (repr(w) for w in (L.NOT_NAME_WORDS, L.NOT_NAME_SHORT))
    return f"""(length({strip}) <= 2 OR regexp_matches({strip}, '[\\[\\]]') OR list_contains({short}, {strip}) OR list_contains({known}, {strip})
      OR regexp_matches({strip}, '^[0-9\\s\\-/.]+$') OR len(list_filter(list_filter(string_split_regex({strip}, '\\s+'), lambda w: w <> ''),
        lambda w: NOT (list_contains({known}, regexp_replace(w, '^[ ,.:;\\-()\\[\\]]+|[ ,.:;\\-()\\[\\]]+$', '', 'g')) OR list_contains({short}, w)))) = 0)"""


CONTEXT_WORDS = " OR ".join(f"contains(lower(line), '{w}')" for w in L.STAFF_CONTEXT)
CAPITAL = r"\b(" + L.NAME_WORD.replace("'", "''") + r"\s+" + L.NAME_WORD.replace("'", "''") + r"(?:\s+" + L.NAME_WORD.replace("'", "''") + r"){0,3})\b"
DR_NAME = r"(?i)\bdr\.?\s*(" + L.NAME_PHRASE.replace("'", "''") + ")"
REVIEW_SQL = f"""
WITH l AS (SELECT doc_id, i AS line_no, lines[i] AS line, CASE WHEN i > 1 THEN lines[i-1] END AS b, CASE WHEN i < len(lines) THEN lines[i+1] END AS a
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT *, trim(line) AS v, CASE WHEN b IS NOT NULL THEN '   ' || (line_no - 1) || ': ' || b || chr(10) ELSE '' END || '>> ' || line_no || ': ' || line ||
  CASE WHEN a IS NOT NULL THEN chr(10) || '   ' || (line_no + 1) || ': ' || a ELSE '' END AS context FROM l),
f AS (
 SELECT doc_id, line_no, context, 'EMAIL_MUNGKIN_BOCOR' AS type, v AS value FROM c WHERE regexp_matches(line, {lit(L.REVIEW_EMAIL)})
 UNION ALL SELECT doc_id, line_no, context, 'NO_HP_MUNGKIN_BOCOR', v FROM c WHERE regexp_matches(line, {lit(L.REVIEW_PHONE)})
 UNION ALL SELECT doc_id, line_no, context, 'ANGKA_PANJANG_MUNGKIN_IDENTIFIER', unnest(regexp_extract_all(line, {lit(L.REVIEW_DIGITS)})) FROM c
 UNION ALL SELECT doc_id, line_no, context, 'SIP_STR_IZIN_PRAKTIK_MUNGKIN_BOCOR', v FROM c WHERE regexp_matches(line, {lit(L.REVIEW_LICENCE)})
 UNION ALL SELECT doc_id, line_no, context, 'BARIS_KONTEKS_STAF_DOKTER_PERLU_REVIEW', v FROM c WHERE {CONTEXT_WORDS}
 UNION ALL SELECT doc_id, line_no, context, 'BARIS_IDENTITAS_ADMINISTRATIF_PERLU_REVIEW', v FROM c WHERE regexp_matches(line, {lit(L.REVIEW_ADMIN)}))
SELECT doc_id, line_no, type, value, context FROM f"""


@query("X-33 W-05 J-10", REVIEW_SQL)
def line_review(t: Tables):
    d = L.review_lines(t.spread("documents").select("doc_id", "text"), ["doc_id"])
    named = ["NAMA_DENGAN_GELAR_MUNGKIN_BOCOR", "DR_NAMA_MUNGKIN_BOCOR", "NAMA_KAPITAL_MUNGKIN_BOCOR"]
    return d.filter(~F.col("type").isin(*named)).withColumn("line_no", F.col("line_no").cast("long"))


@query("X-34 X-33", f"""
WITH l AS (SELECT doc_id, i AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
  SELECT doc_id, string_split(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), chr(10)) AS lines FROM documents))),
f AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{CAPITAL}', 1)) AS c FROM l WHERE {CONTEXT_WORDS} OR length(trim(line)) <= 60)
SELECT doc_id, line_no, trim(c) AS value FROM f WHERE NOT {_not_name("trim(c)")}""")
def capital_names(t: Tables):
    d = L.review_lines(ascii_documents(t), ["doc_id"], kinds=["NAMA_KAPITAL_MUNGKIN_BOCOR"])
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")


@query("X-25", f"""
SELECT doc_id, {_replace_chain('text', R.GENERAL_RULES)} AS text, CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS route FROM documents""")
def length_router(t: Tables):
    """Both routes mask every general identity."""
    d = t.spread("documents").select("doc_id", "text")
    out = X.route_by_length(d, [X.rules_stage(R.GENERAL_RULES)], [X.rules_stage(R.GENERAL_RULES), X.rules_stage([])], limit=2000)
    return out.select("doc_id", "text", "route")


@query("X-25 X-37", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'long' ELSE 'short' END AS route,
 CASE WHEN c_custkey % 2 = 1 THEN '[NIK],[EMAIL],[NO_HP],[NO_RM]' ELSE '[NIK],[EMAIL],[NO_HP]' END AS masked, false AS leaks FROM customer""")
def long_text_identity(t: Tables):
    """The real chains on both sides of the length limit: identities planted at the
    end of short texts and of texts above the limit are masked alike."""
    k = F.col("c_custkey")
    digits = F.lpad(k.cast("string"), 9, "0")
    nik, phone, mail, dashed = F.concat(F.lit("3273012"), digits), F.concat(F.lit("0812"), F.substring(digits, 2, 8)), F.concat(F.lit("a"), k.cast("string"), F.lit("@rs.example.id")), F.lit("12-34-56-78")
    padding = F.repeat(F.lit("keluhan pusing berkurang, makan baik.\n"), F.when(k % 2 == 1, 700).otherwise(3).cast("int"))
    planted = F.concat(padding, F.lit("catatan "), nik, F.lit(" "), mail, F.lit(" "), phone, F.lit("\nkode "), F.when(k % 2 == 1, dashed).otherwise("-"))
    d = t.spread("customer").select("c_custkey", T.normalize(planted).alias("text"))
    out = X.route_by_length(d, X.full_stages([]), X.light_stages([]))
    found = F.array_join(F.regexp_extract_all("text", F.lit(r"\[[A-Z_]+\]"), F.lit(0)), ",")
    leaks = F.col("text").contains("@") | F.col("text").rlike(r"\d(?:\d{7}|\d-\d{2}-\d{2}-\d{2})")
    return out.select("c_custkey", "route", found.alias("masked"), leaks.alias("leaks"))


@query("X-07", """
SELECT doc_id, regexp_replace(regexp_replace(text, 'than the', '[NAMA_RS]', 'gi'), 'nicht', '[NAMA_RS]', 'gi') AS text,
 CAST(len(regexp_extract_all(text, '(?i)than the')) + len(regexp_extract_all(regexp_replace(text, 'than the', '[NAMA_RS]', 'gi'), '(?i)nicht')) AS BIGINT) AS n FROM documents""")
def literal_redaction(t: Tables):
    rules = X.literal_rules(["than the", " nicht ", ""], "[NAMA_RS]", "rs")
    d = X.apply_rules(t.spread("documents").select("doc_id", "text"), rules)
    return d.select("doc_id", "text", F.coalesce(F.try_element_at("counts", F.lit("rs")), F.lit(0)).cast("long").alias("n"))


@query("X-35", f"""
SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, {lit(IP)}), lambda s: contains(x, s)))) AS secret
FROM (SELECT doc_id, text, regexp_replace(text, {lit(EMAIL)}, '[EMAIL]', 'g') AS x FROM documents)""")
def known_secrets(t: Tables):
    secrets = F.array_distinct(F.regexp_extract_all("text", F.lit(IP), F.lit(0)))
    d = t.spread("documents").select("doc_id", secrets.alias("must_not_leak"), "text")
    return L.known_secrets_left(X.apply_rules(d, R.GENERAL_RULES[:1]), ["doc_id"])


# ---------------------------------------------------------------------------
# Notes with planted identities, derived from customers and suppliers.  The SQL
# builds the expected text from the same columns, without any pattern.
# ---------------------------------------------------------------------------
FIRST = ["Budi", "Siti", "Agung", "Dewi", "Rina", "Joko", "Tono", "Wati", "Hadi", "Lina"]
LETTERS = "bdfhjkmqvz"


def first_name(key):
    return F.element_at(F.array(*[F.lit(x) for x in FIRST]), (key % 10 + 1).cast("int"))


def word_of(prefix: str, key):
    return F.concat(F.lit(prefix), F.translate(key.cast("string"), "0123456789", LETTERS))


def sql_word(prefix: str, key: str) -> str:
    return f"('{prefix}' || translate(CAST({key} AS VARCHAR), '0123456789', '{LETTERS}'))"


def sql_first(key: str) -> str:
    return f"{FIRST!r}[{key} % 10 + 1]"


def identity_notes(t: Tables):
    k = F.col("c_custkey")
    name = F.concat_ws(" ", first_name(k), word_of("Nur", k))
    kin = F.concat_ws(" ", first_name(k + 3), word_of("Kar", k))
    digits = F.lpad(k.cast("string"), 9, "0")
    lines = F.array(
        F.concat(F.lit("No. RM: "), digits),
        F.concat(F.lit("NIK: 3201010"), digits),
        F.concat(F.lit("Nama Pasien: "), name),
        F.concat(F.lit("Tgl Lahir: 12/05/"), (1940 + k % 60).cast("string")),
        F.concat(F.lit("Alamat: Jl. Melati No. "), k.cast("string")),
        F.concat(F.lit("HP 0812"), digits, F.lit(" aktif")),
        F.concat(F.lit("Email: user"), k.cast("string"), F.lit("@mail.example")),
        F.concat(F.lit("No. SEP: 0301R0011"), digits),
        F.concat(F.lit("Penanggung Jawab: "), kin),
        F.lit("Dirawat di RS Harapan Bunda"),
        F.lit("Keluhan nyeri kepala sejak 2 hari."),
        F.concat(F.lit("Telp: 022-5"), digits),
    )
    return t.spread("customer").select("c_custkey", F.array_join(lines, "\n").alias("text"))


IDENTITY_KEYS = ["mrn", "nik_labeled", "birthdate", "patient_name", "address", "phone", "email", "sep", "family_name", "hospital", "rs_phone"]


@query("X-02 X-01", f"""
SELECT c_custkey, array_to_string(['[NO_RM]', '[NIK]', 'Nama Pasien: [PASIEN]', 'Tanggal Lahir: [TANGGAL_LAHIR]', 'Alamat: [ALAMAT]', 'HP [NO_HP]aktif',
 'Email: [EMAIL]', '[NO_SEP]', '[KELUARGA]', 'Dirawat di [RUMAH_SAKIT]', 'Keluhan nyeri kepala sejak 2 hari.', '[TELEPON_RS]'], chr(10)) AS text,
 {", ".join(f"CAST(1 AS BIGINT) AS {k}" for k in IDENTITY_KEYS)} FROM customer""")
def identity_rules(t: Tables):
    d = X.apply_rules(identity_notes(t), R.IDENTITY_RULES)
    return d.select("c_custkey", "text", *[F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).cast("long").alias(k) for k in IDENTITY_KEYS])


@query("X-36", """
SELECT c_custkey, array_to_string(['No. RM: [NO_RM]', 'NIK: [NIK]', 'Nama Pasien: [NAMA_PASIEN];', 'Tgl Lahir: [TANGGAL_LAHIR]', 'Alamat: [ALAMAT_PASIEN]',
 'HP [NO_HP] aktif', 'Email: [EMAIL]', 'No. SEP: 0301R0011' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 'Penanggung Jawab: [NAMA_STAF].',
 'Telp: 022-5' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')], chr(10)) AS text FROM customer""")
def keep_field_names(t: Tables):
    d = identity_notes(t).withColumn("text", F.regexp_replace("text", r"\n(Dirawat|Keluhan)[^\n]*", ""))
    d = d.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\nTelp", "\n:Telp"), r"(Nama Pasien: [^\n]*)", "$1;"))
    d = X.apply_rules(d, R.KEEP_FIELD_RULES)
    return d.select("c_custkey", F.replace("text", F.lit("[NAMA_STAF]:Telp"), F.lit("[NAMA_STAF].\nTelp")).alias("text"))


def doctor_notes(t: Tables):
    k = F.col("c_custkey")
    name = F.concat_ws(" ", first_name(k), word_of("N", k))
    code = F.element_at(F.array(*[F.lit(x) for x in ["Sp.N", "Sp.Rad", "Sp.PD", "Sp.JP"]]), (k % 4 + 1).cast("int"))
    lines = F.array(
        F.concat(F.lit("DPJP: dr. "), name, F.lit(", "), code, F.lit(".")),
        F.concat(F.lit("- drg. "), name),
        F.concat(F.lit("- Ns. "), name),
        F.concat(F.lit("- apt. "), name),
        F.concat(F.lit("- Radiografer: "), name),
        F.lit("- kesadaran baik, obat lanjut."),
    )
    return t.spread("customer").select("c_custkey", F.array_join(lines, "\n").alias("text"))


DOCTOR_SQL = """SELECT c_custkey, array_to_string(['DPJP: [' || ['DOKTER_SPESIALIS_NEUROLOGI','DOKTER_SPESIALIS_RADIOLOGI','DOKTER_SPESIALIS_PENYAKIT_DALAM',
 'DOKTER_SPESIALIS_JANTUNG'][c_custkey % 4 + 1] || ']', '- [DOKTER_GIGI]', '- [PERAWAT]', '- [APOTEKER]', '- [RADIOGRAFER]', '- kesadaran baik, obat lanjut.'], chr(10)) AS text"""


@query("X-16 X-12 X-18", DOCTOR_SQL + ", CAST(2 AS BIGINT) AS n_doctors FROM customer")
def doctor_mentions(t: Tables):
    d = X.run_stages(doctor_notes(t), [X.doctor_stage, X.rules_stage(R.STAFF_RULES)])
    doctors = F.map_filter("counts", lambda k, _: k.startswith("doctor_regex_"))
    n = F.aggregate(F.map_values(doctors), F.lit(0), lambda a, x: a + x)
    return d.select("c_custkey", "text", n.cast("long").alias("n_doctors"))


def staff_table(t: Tables):
    """Staff dictionary ``name, role`` from suppliers; a role is given for every
    third entry and inferred for the others."""
    s = F.col("s_suppkey")
    name = F.concat_ws(" ", first_name(s), word_of("Mir", s), word_of("Nur", s))
    return t.spread("supplier").select(
        F.when(s % 3 == 0, F.concat(F.lit("dr. "), name, F.lit(", Sp.N"))).when(s % 3 == 1, F.concat(F.lit("drg. "), name)).otherwise(name).alias("name"),
        F.when(s % 3 == 2, "PERAWAT").otherwise("").alias("role"),
    )


STAFF_SQL = f"""(SELECT s_suppkey AS s, {sql_first('s_suppkey')} AS f, {sql_word('Mir', 's_suppkey')} AS m, {sql_word('Nur', 's_suppkey')} AS n,
 CASE s_suppkey % 3 WHEN 0 THEN 'DOKTER_SPESIALIS_NEUROLOGI' WHEN 1 THEN 'DOKTER_GIGI' ELSE 'PERAWAT' END AS role FROM supplier)"""


@query("S-07 X-08 X-09 X-10 X-11 X-12 W-09", f"""
SELECT variant, role, CAST(length(variant) AS BIGINT) AS n FROM (SELECT unnest([f||' '||m||' '||n, f||' '||m, f||' '||n, m||' '||n]) AS variant, role FROM {STAFF_SQL}) WHERE length(variant) >= 7""")
def staff_variants(t: Tables):
    v = N.staff_variants(staff_table(t))
    return v.select("variant", "role", F.length("variant").cast("long").alias("n"))


def consult_notes(t: Tables):
    k = F.col("c_custkey")
    s = k % 120
    spoken = (
        F.when(k % 3 == 0, F.concat_ws(" ", first_name(s), word_of("Mir", s), word_of("Nur", s)))
        .when(k % 3 == 1, F.concat_ws(", ", first_name(s), word_of("Nur", s)))
        .otherwise(F.upper(F.concat_ws(" ", word_of("Mir", s), word_of("Nur", s))))
    )
    return t.spread("customer").select("c_custkey", F.concat(F.lit("Dikonsulkan ke "), spoken, F.lit(" pagi ini; keluhan membaik.")).alias("text"))


CONSULT_SQL = f"""
SELECT c_custkey, 'Dikonsulkan ke ' || CASE WHEN role IS NOT NULL AND vlen >= 7 THEN '[' || role || ']' ELSE spoken END || ' pagi ini; keluhan membaik.' AS text,
 CASE WHEN role IS NOT NULL AND vlen >= 7 THEN 1 ELSE 0 END AS n_staff
FROM (SELECT c_custkey, st.role, length(CASE c_custkey % 3 WHEN 0 THEN a||' '||b||' '||c WHEN 1 THEN a||' '||c ELSE b||' '||c END) AS vlen,
  CASE c_custkey % 3 WHEN 0 THEN a||' '||b||' '||c WHEN 1 THEN a||', '||c ELSE upper(b||' '||c) END AS spoken
 FROM (SELECT c_custkey, c_custkey % 120 AS k, {sql_first('(c_custkey % 120)')} AS a, {sql_word('Mir', '(c_custkey % 120)')} AS b, {sql_word('Nur', '(c_custkey % 120)')} AS c FROM customer) x
 LEFT JOIN {STAFF_SQL} st ON st.s = x.k)"""


@query("X-13 X-14", CONSULT_SQL)
def staff_redaction(t: Tables):
    d = N.redact_staff(consult_notes(t), N.staff_variants(staff_table(t)), "c_custkey")
    return d.select("c_custkey", "text", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x).alias("n_staff"))


@query("X-14", CONSULT_SQL)
def staff_redaction_join(t: Tables):
    """The way for dictionaries too large to compile; same rows."""
    d = N.redact_staff_join(consult_notes(t), N.staff_variants(staff_table(t)), "c_custkey")
    return d.select("c_custkey", "text", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x).alias("n_staff"))


def header_notes(t: Tables):
    k = F.col("c_custkey")
    name = F.concat_ws(" ", first_name(k), word_of("N", k))
    block = (
        F.when(k % 5 == 0, F.concat(name, F.lit("\nNs. jaga")))
        .when(k % 5 == 1, F.concat(name, F.lit("\nnyeri kepala")))
        .when(k % 5 == 2, F.concat(F.lit("apt. "), name))
        .when(k % 5 == 3, F.concat(name, F.lit(", dr., Sp.N")))
        .otherwise(name)
    )
    return t.spread("customer").select(
        "c_custkey", F.concat(F.lit("Catatan:\n12/05/2024\n08:30\n"), block, F.lit("\nS\nKeluhan berkurang")).alias("text")
    )


@query("X-20", f"""
SELECT c_custkey, 'Catatan:' || chr(10) || '12/05/2024' || chr(10) || '08:30' || chr(10) ||
 CASE c_custkey % 5 WHEN 0 THEN '[PERAWAT]' WHEN 1 THEN {sql_first('c_custkey')} || ' ' || {sql_word('N', 'c_custkey')} || chr(10) || 'nyeri kepala'
  WHEN 2 THEN '[APOTEKER]' WHEN 3 THEN '[DOKTER_SPESIALIS_NEUROLOGI]' ELSE '[PPA]' END || chr(10) || 'S' || chr(10) || 'Keluhan berkurang' AS text,
 CAST(CASE WHEN c_custkey % 5 = 1 THEN 0 ELSE 1 END AS BIGINT) AS n FROM customer""")
def note_headers(t: Tables):
    d = X.run_stages(header_notes(t), [X.note_header_stage])
    return d.select("c_custkey", "text", F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


@query("X-21 X-22", f"""
SELECT c_custkey, 'Visite [DOKTER_SPESIALIS] ' || ['selesai','tunda','ulang'][c_custkey % 3 + 1] || chr(10) || ': [PERAWAT] hadir' AS text FROM customer""")
def label_cleanup(t: Tables):
    k = F.col("c_custkey")
    tail = F.element_at(F.array(F.lit("selesai"), F.lit("tunda"), F.lit("ulang")), (k % 3 + 1).cast("int"))
    repeats = F.repeat(F.lit(", [DOKTER_SPESIALIS]"), (k % 4).cast("int"))
    text = F.concat(
        F.lit("Visite [DOKTER_SPESIALIS]"), repeats, F.lit(" Sp.N"), F.when(k % 2 == 0, "").otherwise(" "), tail, F.lit("  \n: "),
        first_name(k), F.lit(" "), word_of("N", k), F.lit(", [PERAWAT] hadir"),
    )
    text = F.when(k % 2 == 0, F.replace(text, F.lit(" Sp.N"), F.lit(""))).otherwise(text)
    return X.run_stages(t.spread("customer").select("c_custkey", text.alias("text")), [X.cleanup_stage]).select("c_custkey", "text")


@query("X-22", """
SELECT c_custkey, 'Oleh [PERAWAT] jam ' || CAST(c_custkey % 24 AS VARCHAR) AS text, CAST(CASE WHEN c_custkey % 4 > 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM customer""")
def duplicate_label_collapse(t: Tables):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Oleh [PERAWAT]"), F.repeat(F.lit(", [PERAWAT]"), (k % 4).cast("int")), F.lit(" jam "), (k % 24).cast("string"))
    d = X.apply_rules(t.spread("customer").select("c_custkey", text.alias("text")), [R.CLEANUP_RULES[-1]])
    return d.select("c_custkey", "text", F.coalesce(F.try_element_at("counts", F.lit("cleanup_duplicate_labels")), F.lit(0)).cast("long").alias("n"))


@query("X-17", f"""
SELECT c_custkey, '1. visite' || chr(10) || CASE c_custkey % 2 WHEN 0 THEN '[DOKTER_SPESIALIS_NEUROLOGI]' ELSE '[DOKTER_UMUM]' END || chr(10) || '2. obat lanjut' AS text FROM customer""")
def split_line_doctors(t: Tables):
    k = F.col("c_custkey")
    name = F.concat_ws(" ", first_name(k), word_of("N", k))
    text = F.concat(F.lit("1. visite\n"), name, F.lit(",\n"), F.when(k % 2 == 0, "dr, Sp.N").otherwise("dr."), F.lit("\n2. obat lanjut"))
    return X.run_stages(t.spread("customer").select("c_custkey", text.alias("text")), [X.split_line_stage]).select("c_custkey", "text")


@query("X-05 X-06 P-02", """
SELECT c_custkey, chr(10) || chr(10) || 'Kesan: infark lama.' || chr(10) || 'Lokasi [LOKASI_RS]' AS text FROM customer""")
def footer_lines(t: Tables):
    k = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("No. Foto: F-"), k, F.lit("\nRuangan: Mawar "), k, F.lit("\nKesan: infark lama.\nLokasi Bandung - Jawa Barat."),
    )
    d = X.apply_rules(t.spread("customer").select("c_custkey", text.alias("text")), R.FOOTER_RULES)
    return d.select("c_custkey", T.squeeze_blank_lines(F.regexp_replace(F.regexp_replace("text", r"^\[NO_FOTO\]", ""), r"^\n*", "\n\n")).alias("text"))


@query("X-03 X-04", """
SELECT c_custkey, '[HEADER_FOOTER_RS]' || chr(10) || '[NAMA_PASIEN]' || chr(10) || 'Kontak [EMAIL]' || chr(10) || 'Keluhan pusing berat' || repeat(chr(10) || 'Tindak lanjut rutin', 12) AS text,
 CAST(1 AS BIGINT) AS n_header FROM customer""")
def mask_identity(t: Tables):
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("Telp Fax bagian umum\nNama: "), first_name(k), F.lit(" "), word_of("N", k), F.lit("\nKontak u"), k.cast("string"),
        F.lit("@mail.example\nKeluhan pusing berat"), F.repeat(F.lit("\nTindak lanjut rutin"), 12),
    )
    d = X.mask_identity(t.spread("customer").select("c_custkey", text.alias("text")))
    return d.select("c_custkey", "text", F.coalesce(F.try_element_at("counts", F.lit("header_footer_rs")), F.lit(0)).cast("long").alias("n_header"))


@query("X-38", """
SELECT c_custkey, 'Rujukan dari [RUMAH_SAKIT]; alamat [ALAMAT_RS]' AS text FROM customer""")
def facility_names(t: Tables):
    k = F.col("c_custkey")
    sep = F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("  ")), (k % 3 + 1).cast("int"))
    text = F.concat(F.lit("Rujukan dari Bina"), sep, F.lit("Sehat"), sep, F.lit("Mulia; alamat Jl. Kenanga No. "), k.cast("string"))
    return X.apply_rules(t.spread("customer").select("c_custkey", text.alias("text")), X.facility_rules(["Bina Sehat Mulia"])).select("c_custkey", "text")


@query("X-26 U-04 U-05", f"""
SELECT c_custkey, 'Perawat: [NAMA];' || chr(10) || 'konsul ke [NAMA]; [NAMA] setuju' AS text, CAST(2 AS BIGINT) AS n FROM customer""")
def harvested_names(t: Tables):
    k = F.col("c_custkey")
    nurse = F.concat_ws(" ", F.concat(F.lit("Per"), F.lower(first_name(k))), word_of("Nab", k))
    doctor = F.concat(F.lit("Doc"), F.translate(k.cast("string"), "0123456789", LETTERS))
    text = F.concat(F.lit("Perawat: "), nurse, F.lit(";\nkonsul ke "), doctor, F.lit("; "), nurse, F.lit(" setuju"))
    d = X.harvest_names(t.spread("customer").select("c_custkey", text.alias("text")))
    return X.replace_harvested(d).select("c_custkey", "text", F.size("candidates").cast("long").alias("n"))


@query("X-15 X-19 X-37", """
SELECT c_custkey, '[PERAWAT]; lapor [DOKTER]; obat lanjut' AS text FROM customer""")
def light_chain(t: Tables):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Ns. "), first_name(k), F.lit(" "), word_of("N", k), F.lit("; lapor dr. "), word_of("Qar", k), F.lit("; obat lanjut"))
    stages = X.light_stages(X.literal_rules(["Bidan Mawar"], "[BIDAN]", "STAFF_EXACT_BIDAN", 5))
    return X.run_stages(t.spread("customer").select("c_custkey", T.normalize(text).alias("text")), stages).select("c_custkey", "text")


@query("X-28", """
SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS sisa_ners, CAST(CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS sisa_apt,
 CAST(CASE c_custkey % 3 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS possible_no_foto_leftover FROM customer""")
def older_leftovers(t: Tables):
    k = F.col("c_custkey")
    text = F.element_at(F.array(F.lit("jaga: Ners malam"), F.lit("oleh Apt. jaga"), F.lit("lihat No. Foto lama")), (k % 3 + 1).cast("int"))
    rules = R.OLDER_LEFTOVER_RULES + R.POSSIBLE_LEFTOVER_RULES
    d = X.scan_leftovers(t.spread("customer").select("c_custkey", text.alias("text")), rules)
    return d.select(
        "c_custkey",
        *[F.coalesce(F.try_element_at("leftovers", F.lit(c)), F.lit(0)).cast("long").alias(c) for c in ["sisa_ners", "sisa_apt", "possible_no_foto_leftover"]],
    )


@query("X-27", """
SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS leftover_sp FROM customer""")
def excused_specialists(t: Tables):
    k = F.col("c_custkey")
    pad = F.when(k % 3 == 1, F.repeat(F.lit("- "), 60)).otherwise("")
    label = F.when(k % 3 == 2, "[PERAWAT]").otherwise("[DOKTER_UMUM]")
    text = F.concat(label, F.lit(" "), pad, F.lit("Sp.Rad selesai"))
    d = X.scan_leftovers(t.spread("customer").select("c_custkey", text.alias("text")))
    return d.select("c_custkey", F.coalesce(F.try_element_at("leftovers", F.lit("leftover_sp")), F.lit(0)).cast("long").alias("leftover_sp"))


@query("X-23 X-37", f"""
SELECT c_custkey, array_to_string(['[NO_RM]', 'Nama Pasien: [PASIEN]', 'DPJP: [DOKTER_SPESIALIS_NEUROLOGI]', '- [PERAWAT]', '- keluhan pusing berkurang, makan baik.'], chr(10)) AS text,
 false AS needs_manual_review FROM customer""")
def full_redaction(t: Tables):
    """The whole pipeline: normalise, six stages twice, leftover scan."""
    k = F.col("c_custkey")
    name = F.concat_ws(" ", first_name(k), word_of("N", k))
    lines = F.array(
        F.concat(F.lit("No.  RM: "), F.lpad(k.cast("string"), 9, "0")),
        F.concat(F.lit("Nama Pasien: "), name),
        F.concat(F.lit("DPJP: dr. "), name, F.lit(", Sp.N.")),
        F.concat(F.lit("- Ns. "), name),
        F.lit("- keluhan pusing berkurang, makan baik."),
    )
    d = X.redact(t.spread("customer").select("c_custkey", F.array_join(lines, "\r\n").alias("text")))
    return d.select("c_custkey", "text", "needs_manual_review")


@query("X-23 A-24 A-25")
def full_redaction_documents(t: Tables):
    """The whole pipeline over the given documents (look-behind and back-references
    have no SQL form; the stages are checked one by one)."""
    d = X.redact(t.spread("documents").select("doc_id", "text"), N.staff_variants(staff_table(t)), key="doc_id")
    return d.select("doc_id", F.length("text").alias("chars_out"), F.map_entries("counts").alias("counts"), F.map_entries("leftovers").alias("leftovers"))
