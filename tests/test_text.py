from pyspark.sql import functions as F

from notewarden.functions import text as T
from notewarden.operators import classify as C, records as Rec


def test_normalize(one):
    assert one(T.normalize("text"), "a\r\nb\rc d \t e") == "a\nb\nc d e"


def test_clean_snippet_cap(one):
    got = one(T.clean_snippet("text"), "x" * 600)
    assert got == "x" * 500 + " ...[truncated]"
    assert one(T.clean_snippet("text"), "  a \n b ") == "a b"


def test_match_spans_positions(one):
    spans = one(T.match_spans("text", r"\d+"), "a12 b3\n456")
    assert [(s["start"], s["hit"]) for s in spans] == [(1, "12"), (5, "3"), (7, "456")]
    assert one(T.match_spans("text", r"\d+"), "none") == []


def test_replace_each_is_positional(one):
    # the second 'ab' is not a match and must stay
    got = one(T.replace_each("text", r"\bab\b", lambda h: F.concat(F.lit("<"), F.upper(h), F.lit(">"))), "ab xab ab")
    assert got == "<AB> xab <AB>"


def test_dates(one):
    assert one(T.parse_date_text("text"), "pada 6 Mei 2026 pagi") == "2026-05-06"
    assert one(T.parse_date_text("text"), "17 Agustus 2025") == "2025-08-17"
    assert one(T.parse_date_text("text"), "2024-02-29 x") == "2024-02-29"
    assert one(T.parse_date_text("text"), "besok") is None
    assert str(one(T.parse_day_first_date("text"), "5/3/2024")) == "2024-03-05"
    assert one(T.parse_day_first_date("text"), "31/02/2024") is None


def test_numbers_and_sentinels(one):
    assert one(T.first_number("text"), "Hb 12,5 g") == "12.5"
    assert one(T.first_number("text"), "x") == "unknown"
    assert one(T.missing_to_null("text"), "unknown") is None
    assert one(Rec.coerced_text("text", F.lit("numeric")), "12,0") == "12"
    assert one(Rec.coerced_text("text", F.lit("numeric")), "12.500") == "12.5"
    assert one(Rec.coerced_text("text", F.lit("numeric")), "ada (+)") == "ada (+)"
    assert one(Rec.coerced_text("text", F.lit("text")), "") is None


def test_names_and_paths(one):
    assert one(T.safe_name("text"), " a/b? ") == "a_b"
    assert one(T.safe_name("text"), "??") == "pasien"
    assert one(T.safe_path("text"), "RS A\\pasien 1//x") == "RS_A/pasien_1/x"
    assert one(T.clean_value("text"), " :- nilai  dua ,") == "nilai dua"


def test_decode(spark):
    rows = spark.createDataFrame([("﻿abé".encode("utf-8"),), ("abé".encode("latin-1"),)], "b binary")
    assert [r[0] for r in rows.select(T.decode_bytes("b")).collect()] == ["abé", "abé"]


def test_source_fallback(spark):
    long = "x" * 60
    d = spark.createDataFrame([(long, "y" * 70), ("a", long), ("a", "b")], "p string, q string")
    rows = d.select(T.choose_text([("first", F.col("p")), ("second", F.col("q"))]).alias("c")).select("c.*").collect()
    assert [r["extraction_status"] for r in rows] == ["first", "second", "pdf_empty_or_failed"]


def test_document_types(spark):
    d = spark.createDataFrame([("Resume_rad.txt",), ("CT_kepala.txt",), ("lab_igd.txt",), ("cppt_igd.txt",), ("x.txt",)], "f string")
    assert [r[0] for r in d.select(C.doc_type_by_name("f")).collect()] == ["resume", "other", "lab", "cppt_igd", "other"]
    assert [r[0] for r in d.select(C.doc_type_by_name_wide("f")).collect()] == ["resume", "radiology", "lab", "cppt_igd", "other"]


def test_content_class_ties_keep_the_earlier(one):
    assert one(C.class_by_content("text"), "hasil laboratorium dan radiologi") == "LAB"
    assert one(C.class_by_content("text"), "resume medis, kondisi pulang baik") == "RESUME"
    assert one(C.class_by_content("text"), "teks biasa") == "LAINNYA"


def test_vital_checks(one):
    assert one(Rec.check_blood_pressure("text"), "180/100") == "180/100 mmHg"
    assert one(Rec.check_blood_pressure("text"), "300/100") == ""
    assert one(Rec.check_gcs("text"), "E4V5M6") == "E4V5M6"
    assert one(Rec.check_gcs("text"), "E1V0M1") == ""
    assert one(Rec.check_gcs("text"), "20") == ""
    assert one(Rec.check_glucose("text"), "900 mg/dL") == ""


def test_validation_runs_before_coercion(spark):
    d = spark.createDataFrame([("gcs", "16"), ("gcs", "15"), ("suhu", "36,5"), ("lain", "999"), ("gcs", "x")], "field string, value string")
    rows = {(r["field"], r["value"], r["warning"]) for r in Rec.validate(d).collect()}
    assert ("gcs", "invalid", "GCS=16 (range: 3-15)") in rows
    assert ("gcs", "15", None) in rows and ("lain", "999", None) in rows and ("gcs", "x", None) in rows
