"""Readings and recorded flags on single notes."""

from notewarden.operators import classify as C, clinical as K, evidence as V


def read(spark, extractor, *files):
    """Fields of one patient with the given ``(file, text)`` pairs."""
    d = spark.createDataFrame([("p", f, t) for f, t in files], "patient_id string, source_file string, text string")
    d = d.withColumn("doc_type", C.doc_type_by_name("source_file"))
    return {r["field"]: r["value"] for r in extractor(d).collect()}


def test_parts_of_a_score_in_either_order(spark):
    for note in ("GCS: E4 V5 M6", "E4M6V5", "gcs=e 4 v 5 m 6"):
        got = read(spark, V.initial_gcs, ("cppt_igd.txt", note))
        assert (got["gcs_initial_total"], got["gcs_eye"], got["gcs_motor"], got["gcs_verbal"]) == ("15", "4", "6", "5")
        assert got["gcs_initial_text"] == note


def test_type_goes_before_place_and_place_counts_characters(spark):
    wide = "\U0001F600" * 120
    got = read(spark, V.initial_gcs, ("resume.txt", "GCS 15"), ("cppt_igd.txt", f"{wide} GCS 9 koma"), ("rad_ct.txt", "GCS 3"))
    assert got["gcs_initial_total"] == "9" and got["gcs_source"] == "cppt_igd.txt"
    assert got["gcs_evidence"] == wide[:99] + " GCS 9 koma"
    assert got["consciousness_text"] == "koma"


def test_pressure_out_of_range_is_passed_over(spark):
    got = read(spark, V.initial_pressure, ("surat.txt", "TD 400/90, tensi 49/60 BP: 300/200 TD 120/80"))
    assert (got["blood_pressure_initial"], got["systolic_bp_initial"], got["diastolic_bp_initial"]) == ("300/200", "300", "200")


def test_nothing_found_is_unknown(spark):
    files = [("cppt_igd.txt", None), ("resume.txt", "")]
    assert read(spark, V.initial_pressure, *files) == {n: "unknown" for n in ("blood_pressure_initial", "systolic_bp_initial", "diastolic_bp_initial")}
    assert read(spark, V.initial_nihss, *files, ("lab.txt", "NIHSS 4")) == {"nihss_score": "unknown", "nihss_documented": "no"}
    assert read(spark, V.initial_nihss, ("resume.txt", "NIHSS 43 NIHSS: 42")) ["nihss_score"] == "42"


def test_abbreviations_need_any_case(spark):
    note = ("resume.txt", "Riwayat HT dan AF, Aspirin; rawat ICU\nRPD: hipertensi sejak sepuluh tahun lalu\nlain")
    plain = read(spark, V.recorded_risks, note)
    assert plain["atrial_fibrilasi"] == "tidak_tercatat" and plain["hipertensi"] == "ada"
    assert read(spark, V.recorded_flags(V.RECORDED_RISKS, "ada", any_case=True), note)["atrial_fibrilasi"] == "ada"
    assert read(spark, V.drug_classes, note)["antiplatelet_aspirin"] == "diberikan"
    assert read(spark, V.earlier_illness, note) == {"rpd_text": "hipertensi sejak sepuluh tahun lalu"}
    both = {r["field"] for r in K.run_extractors(
        spark.createDataFrame([("p", "resume.txt", "resume", "ekg")], "patient_id string, source_file string, doc_type string, text string"),
        [V.recorded_actions, V.drug_classes]).collect()}
    assert both == {*V.RECORDED_ACTIONS, *V.DRUG_CLASSES}
