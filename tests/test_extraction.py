import random

import pytest
from notewarden.operators import clinical as K, extract as E, lines as L, nested as N
from notewarden.operators.extract import FieldRule, KeywordRule


def docs(spark, *rows):
    return spark.createDataFrame([(p, f, d, t, i) for i, (p, f, d, t) in enumerate(rows)], "patient_id string, source_file string, doc_type string, text string, doc_seq long")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("pasien tidak ada demam", "tidak"), ("tanpa demam", "tidak"), ("demam (+) sejak pagi", "ada"), ("keluhan demam tinggi", "ada"),
        ("belum ada demam", "tidak"), ("tidak demam kemarin dan hari ini lalu muncul keluhan berupa demam (+)", "ada"), ("demamnya", None), ("sehat", None),
    ],
)
def test_negation(spark, text, expected):
    d = docs(spark, ("p", "a", "resume", text))
    rows = E.keyword_fields(d, [KeywordRule("f", ("demam",))]).collect()
    assert [r["value"] for r in rows] == ([] if expected is None else [expected])


def reference_negated(tokens, word):
    pos = neg = False
    for i, tok in enumerate(tokens):
        if word not in tok:
            continue
        after, before = tokens[i + 1 : i + 6], tokens[max(0, i - 5) : i]
        if any(t in E.POSITIVE_MARKERS or "(+)" in t for t in after[:3]):
            pos = True
        elif any(t in E.NEGATION_WORDS for t in before + after):
            neg = True
    return neg and not pos


def test_windows_cross_documents_and_buckets(spark):
    """Brute force over the joined text, with tiny documents and a span so small
    that neighbours lie in other buckets."""
    rnd = random.Random(5)
    rows = []
    for p in range(6):
        for i in range(rnd.randint(1, 25)):
            words = [rnd.choice(["demam", "tidak", "ada", "x", "y", "z", "(+)", "nyeri"]) for _ in range(rnd.randint(1, 4))]
            rows.append((f"p{p}", i, " ".join(words)))
    d = spark.createDataFrame(rows, "patient_id string, doc_seq long, text string")
    import notewarden.skew as skew

    old = skew.neighbour_items.__defaults__
    skew.neighbour_items.__defaults__ = (2,)
    try:
        got = {(r["patient_id"], r["field"]): r["value"] for r in E.keyword_fields(d, [KeywordRule("f", ("demam",)), KeywordRule("g", ("nyeri",))]).collect()}
    finally:
        skew.neighbour_items.__defaults__ = old
    expected = {}
    for p in {r[0] for r in rows}:
        tokens = " ".join(t for q, _, t in sorted(rows) if q == p).split()
        for f, w in (("f", "demam"), ("g", "nyeri")):
            if w in tokens:
                expected[(p, f)] = "tidak" if reference_negated(tokens, w) else "ada"
    assert got == expected


def test_regex_priority_then_file_order(spark):
    d = docs(
        spark, ("p", "a.txt", "lab", "Hb: 9"), ("p", "b.txt", "resume", "Hb: 10"), ("p", "c.txt", "resume", "Hb: 11"), ("q", "a.txt", "lab", "Hb: 7"), ("q", "b.txt", "other", "Hb: 8")
    )
    rows = E.regex_fields(d, [FieldRule("hb", r"Hb:\s*(\d+)", ("resume", "lab")), FieldRule("any", r"Hb"), FieldRule("none", r"zz")]).collect()
    assert {(r["patient_id"], r["field"], r["value"]) for r in rows} == {("p", "hb", "10"), ("q", "hb", "7"), ("p", "any", "ada"), ("q", "any", "ada")}


def test_dotall_is_opt_in(spark):
    d = docs(spark, ("p", "a", "resume", "Kesan: satu\ndua"))
    rows = {r["field"]: r["value"] for r in E.regex_fields(d, [FieldRule("off", r"Kesan:\s*(.{2,50})"), FieldRule("on", r"Kesan:\s*(.{2,50})", dotall=True)]).collect()}
    assert rows == {"off": "satu", "on": "satu dua"}


def test_group_detection():
    assert FieldRule("x", r"(?:a|b)\s*(c)").has_group and not FieldRule("x", r"(?i)I21\.[0-9]|\(x\)").has_group and not FieldRule("x", r"[(]a[)]").has_group


def test_medications(spark):
    d = docs(
        spark, ("p", "a", "resume", "Terapi: Aspilet 80mg/24 jam selama 5 hari"), ("p", "b", "resume", "aspilet 160 mg"), ("q", "a", "resume", "tanpa obat")
    )
    drugs = {"med_a": ["aspilet", "clopidogrel"], "med_b": ["statin"], "_note": ["x"]}
    rows = {(r["patient_id"], r["drug_key"]): r for r in E.medications(d, drugs).collect()}
    assert len(rows) == 4
    a = rows[("p", "med_a")]
    assert (a["value"], a["detail"], a["dose"], a["duration"]) == ("ada", "aspilet", "aspilet 80mg/24 jam", "selama 5 hari")
    assert rows[("q", "med_a")]["value"] == "tidak" and rows[("p", "med_b")]["detail"] == ""
    assert E.medications(d, drugs, selected=[]).count() == 0


def test_demographics_stop_when_both_known(spark):
    d = docs(
        spark, ("p", "a", "x", "Umur: 50"), ("p", "b", "x", "Umur: 51 Tahun\nJK: L"), ("p", "c", "x", "Umur: 60 JK: P"), ("q", "a", "x", "Umur: 1"), ("q", "b", "x", "Umur: 2")
    )
    rows = {(r["patient_id"], r["field"]): r["value"] for r in K.demographics(d).collect()}
    assert rows == {("p", "age"): "51", ("p", "gender"): "Laki-laki", ("q", "age"): "2"}


def test_diagnosis_lead_matches_the_plain_pattern(spark):
    import re

    core, tail = K.DIAGNOSIS[1]
    plain = re.compile(rf".{{0,80}}{core}{tail}", re.I | re.S)
    rnd = random.Random(3)
    texts = []
    for _ in range(40):
        parts = [rnd.choice(["kata ", "baris\n", "stroke iskemik ", "SNH ", "x" * rnd.randint(1, 60) + " "]) for _ in range(rnd.randint(1, 12))]
        texts.append("".join(parts))
    d = docs(spark, *[(str(i), "a", "resume", t) for i, t in enumerate(texts)])
    old = list(K.DIAGNOSIS)
    K.DIAGNOSIS[:] = [old[1]]
    try:
        got = {r["patient_id"]: r["value"] for r in K.diagnosis(d).filter("field = 'diagnosis_text'").collect()}
    finally:
        K.DIAGNOSIS[:] = old
    for i, t in enumerate(texts):
        m = plain.search(t)
        want = None if m is None else re.sub(r"\s+", " ", m.group(0)).strip()
        if want is not None and len(want) > 450:
            want = want[:450] + " ...[truncated]"
        assert got.get(str(i)) == want


def test_diagnosis_query_reads_every_note(spark, monkeypatch, tmp_path):
    """Evidence of a patient without a resume stands in other notes."""
    from notewarden.plans import clinical_queries as Q

    spark.range(1, 5).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    rows = [
        ("1", "rad_ct.txt", "radiology", "KESIMPULAN: infark lama di thalamus"), ("2", "cppt_igd.txt", "cppt_igd", "Diagnosis: stroke hemoragik"),
        ("3", "resume.txt", "resume", "Diagnosis: stroke hemoragik"), ("3", "rad_ct.txt", "radiology", "KESIMPULAN: infark"),
    ]
    notes = docs(spark, *rows).selectExpr("cast(patient_id as long) patient_id", "source_file", "doc_type", "text")
    monkeypatch.setattr(Q, "clinical_notes", lambda t: notes)
    got = {r["patient_id"]: r["stroke_type"] for r in Q.diagnosis(Q.Tables(spark, str(tmp_path))).collect()}
    assert got == {1: "INFARK", 2: "HEMORAGIK", 3: "HEMORAGIK", 4: None}


def test_soft_paragraphs_brute_force(spark):
    rnd = random.Random(1)
    texts = ["\n".join(rnd.choice(["a", "b.", "", "c d", "e;"]) for _ in range(rnd.randint(0, 30))) for _ in range(20)]

    def brute(text):
        blocks, buf = [], []
        for line in [x for x in (" ".join(s.split()) for s in text.split("\n")) if x]:
            buf.append(line)
            if len(buf) >= 4 or line[-1] in ".!?;:":
                blocks.append(" ".join(buf))
                buf = []
        return blocks + ([" ".join(buf)] if buf else [])

    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["b"] for r in d.select("id", L.soft_paragraphs("text").alias("b")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_context_lines(spark):
    d = spark.createDataFrame([(1, "satu\nstroke 08:00\nok\nstroke 09:00\nlima")], "id int, text string")
    rows = {(r["line_no"], r["line"]) for r in L.categorized_lines(d, ["id"], {"c": ["stroke"]}).collect()}
    assert rows == {(1, "satu"), (2, "stroke 08:00"), (5, "lima")}  # 'ok' is noise, line 4 repeats line 2


def test_nested_roles(spark):
    d = spark.createDataFrame([("lab_1", "Hemoglobin : 10.2 g/dL\nHemoglobin : 10.2 g/dL\nNama : 5"), ("x", "Diagnosis: stroke")], "stem string, text string")
    rows = {r["stem"]: r for r in N.extract_nested(d, ["stem"], targets={"radio": False}).collect()}
    assert [(i["nama"], i["nilai"], i["satuan"]) for i in rows["lab_1"]["laboratorium"]["items"]] == [("Hemoglobin", "10.2", "g/dL")]
    assert rows["lab_1"]["klinis"] is None and rows["x"]["klinis"]["diagnosis"] == ["stroke"] and rows["x"]["radiologi"] is None


def test_fever_and_lab_dates(spark):
    d = docs(
        spark, ("p", "cppt_igd.txt", "cppt_igd", "S: 37,5 C"), ("p", "cppt_ranap.txt", "cppt_ranap", "suhu 39, S: 38.4"), ("p", "lab_igd.txt", "lab", "Tgl. Sampling: 06 Mei 2026"),
        ("p", "lab_2.txt", "lab", "Tgl. Sampling: 05 Mei 2026"),
    )
    fever = {r["field"]: r["value"] for r in K.fever(d).collect()}
    assert fever == {"demam_saat_masuk": "tidak", "demam_selama_rawat": "ada", "suhu_tertinggi": "38.4"}
    dates = {r["field"]: r["value"] for r in K.lab_dates(d).collect()}
    assert dates == {"lab_tanggal_igd": "2026-05-06", "lab_tanggal_ranap": "2026-05-05", "lab_tanggal_pertama": "2026-05-05"}


def test_lab_values_of_any_wanted_length(spark):
    d = spark.createDataFrame([("lab_1", "Trombosit 250000 /uL\nLeukosit 5400123 /uL\nUreum 33 mg/dL")], "stem string, text string")
    def names(**kw):
        return [r["nama"] for r in N.extract_nested(d, ["stem"], **kw).first()["laboratorium"]["items"]]

    assert names() == ["Ureum"] and names(lab_digits=6) == ["Trombosit", "Ureum"] and names(lab_digits=7) == ["Trombosit", "Leukosit", "Ureum"]


def test_nested_extract_query_on_large_keys(spark, tmp_path):
    from notewarden.plans import load_all

    spark.range(5_400_000, 5_400_020).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    rows = load_all()["nested_extract"].run(spark, str(tmp_path)).filter("stem = 'lab_1'").collect()
    assert len(rows) == 20 and all(f"Leukosit={5000 + r['patient_id']} /uL" in r["items"] for r in rows)
