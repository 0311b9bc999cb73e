import pytest

from notewarden.operators import variance as V
from notewarden.operators.variance import Standard, StayTarget

STANDARDS = [
    Standard("A", "ct", "ada", "CT"), Standard("A", "hb", "ada", "Hb"), Standard("B", "gcs", "15", "GCS", "rekomendasi", "", "numeric"),
    Standard("B", "kelas", "Satu", "Kelas", "rekomendasi", "", "string"), Standard("B", "lain", "[]", "Lain", "wajib", "", "other"), Standard("B", "lama_rawat_hari", "ada", "Lama"),
]
TARGET = StayTarget(5, 10)


def record(spark, rows):
    return spark.createDataFrame(rows, "patient_id string, field string, value string")


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("full", "ct", "ada"), ("full", "hb", "12.5"), ("full", "gcs", "15"), ("full", "kelas", " satu "), ("full", "lama_rawat_hari", "7"),
        ("mixed", "ct", "Tidak "), ("mixed", "gcs", "abc"), ("mixed", "kelas", "dua"), ("mixed", "lama_rawat_hari", "15"), ("mixed", "hb", "tidak_ada"), ("empty", "umur", None),
        ("short", "lama_rawat_hari", "3"), ("short", "gcs", "14"),
    ]
    return V.compare(record(spark, rows), STANDARDS, TARGET).cache()


def classes(facts, pid):
    return {(r["section"], r["field"]): r["variance_type"] for r in facts.filter(f"patient_id = '{pid}'").collect()}


def test_classes(facts):
    full = classes(facts, "full")
    assert full[("A", "ct")] == full[("A", "hb")] == full[("B", "gcs")] == full[("B", "kelas")] == full[("LOS Target", "lama_rawat_hari")] == "compliant"
    assert full[("B", "lain")] == "not_assessable"
    mixed = classes(facts, "mixed")
    assert mixed[("A", "ct")] == "deviation" and mixed[("B", "gcs")] == "not_assessable" and mixed[("B", "kelas")] == "deviation"
    assert mixed[("A", "hb")] == "compliant"  # 'tidak_ada' is not in the negative list
    empty = classes(facts, "empty")
    assert empty[("A", "ct")] == "missing" and empty[("B", "gcs")] == "not_assessable" and ("LOS Target", "lama_rawat_hari") not in empty


def test_class_counts_sum_to_total(facts):
    for r in V.patient_summary(facts, "CP", TARGET).collect():
        assert r["compliant"] + r["deviation"] + r["missing"] + r["not_assessable"] == r["total_standards"]


def test_rates_and_verdicts(facts):
    rows = {r["patient_id"]: r for r in V.patient_summary(facts, "CP", TARGET).collect()}
    assert rows["full"]["compliance_rate_pct"] == 100.0 and rows["empty"]["compliance_rate_pct"] == 0.0
    assert rows["full"]["los_variance"] == "Sesuai target (5-10 hari)" and rows["mixed"]["los_variance"] == "Di atas target (15 > 10 hari)"
    assert rows["short"]["los_variance"] == "Di bawah target (3 < 5 hari)" and rows["empty"]["los_variance"] is None
    assert rows["full"]["los_target"] == "5-10"


def test_stay_row_severity(facts):
    rows = {r["patient_id"]: r["severity"] for r in facts.filter("section = 'LOS Target'").collect()}
    assert rows == {"full": "wajib", "mixed": "wajib", "short": "rekomendasi"}


def test_stay_stats(spark):
    s = spark.createDataFrame([(7.0,), (12.0,), (3.0,), (None,)], "los_actual double")
    r = V.stay_stats(s, TARGET).first()
    assert (r["n"], round(r["mean"], 1), r["median"], r["above_target"], r["below_target"], r["within_target"]) == (3, 7.3, 7.0, 1, 1, 1)


def test_no_patients(spark):
    none = V.compare(record(spark, []), STANDARDS, TARGET)
    r = V.cohort_summary(V.patient_summary(none, "CP", TARGET)).first()
    assert (r["patients"], r["avg_compliance_rate"], r["total_missing"]) == (0, 0.0, 0)
    assert V.stay_stats(V.patient_summary(none, "CP", TARGET), TARGET).first()["n"] == 0


def test_field_summary_merges_the_stay_rows(facts):
    rows = {r["field"]: r for r in V.field_compliance(facts).collect()}
    assert rows["lama_rawat_hari"]["total"] == 4 + 3 and rows["lama_rawat_hari"]["label"] == "Lama"
    assert V.field_compliance(facts, by_section=True).count() == 7


def test_gaps(facts):
    rows = {r["patient_id"]: r["gaps"] for r in V.mandatory_gaps(facts).collect()}
    assert rows["empty"] == "CT; Hb; Lama" and "full" not in rows


def test_notes(facts):
    notes = {(r["patient_id"], r["field"]): r["note"] for r in facts.filter("section <> 'LOS Target'").collect()}
    assert notes[("empty", "ct")] == "CT tidak terdokumentasi" and notes[("mixed", "gcs")] == "Nilai 'abc' bukan angka"
    assert notes[("short", "gcs")] == "Nilai: 14 (expected: 15)" and notes[("empty", "gcs")] == "GCS tidak tercatat, tidak bisa dinilai"
    assert notes[("mixed", "kelas")] == "Dokumentasi: 'dua' (expected: 'Satu')"
