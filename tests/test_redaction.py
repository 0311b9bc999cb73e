import pytest
from pyspark.sql import functions as F

from notewarden import rules as R
from notewarden.operators import leaks as L, names as N, redact as X
from notewarden.rules import Rule


def frame(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")


@pytest.mark.parametrize(
    "name,role",
    [("dr. Uji Coba, Sp.N", "DOKTER_SPESIALIS_NEUROLOGI"), ("Sp. Rad", "DOKTER_SPESIALIS_RADIOLOGI"), ("dr. Uji", "DOKTER_UMUM"), ("drg. Uji", "DOKTER_GIGI"), ("XYZ", "DOKTER"), ("Uji, Sp. Qx", "DOKTER_SPESIALIS")],
)
def test_roles(one, name, role):
    assert one(N.role_of("text"), name) == role


def test_empty_text(spark):
    row = X.redact(frame(spark, "")).first()
    assert row["text"] == "" and row["counts"] == {} and row["leftovers"] == {} and row["needs_manual_review"] is False


RECORD = """RS Uji Sentosa
No. RM: 00-11-22
No. SEP: 0001R0010002V0003
Nama Pasien: Uji Cobawati
Tgl Lahir: 01/02/1960
NIK: 3200000000000001
Alamat: Jl. Contoh No. 5 RT 01
HP 081234567890 rumah
surel uji@contoh.example
DPJP: dr. Palsu Namadia, Sp.N.
- Ns. Rekaan Satu
Keluhan lemah anggota gerak kanan, stroke infark"""
SECRETS = ["00-11-22", "0001R0010002V0003", "Cobawati", "01/02/1960", "3200000000000001", "Contoh No. 5", "081234567890", "uji@contoh.example", "Namadia", "Rekaan"]


def test_full_pipeline_leaks_nothing(spark):
    out = X.redact(frame(spark, RECORD)).cache()
    text = out.first()["text"]
    assert "stroke infark" in text and "lemah anggota gerak" in text
    planted = out.withColumn("must_not_leak", F.array(*[F.lit(s) for s in SECRETS]))
    assert L.known_secrets_left(planted, ["id"]).count() == 0, text


def test_zero_counts_mean_unchanged_text(spark):
    clean = "pasien tenang, makan habis\nobat lanjut"
    row = X.redact(frame(spark, clean)).first()
    assert row["counts"] == {} and row["text"] == clean


def test_general_rules_are_idempotent(spark):
    d = X.apply_rules(frame(spark, "a@b.cd 1234567890123456 +1 (222) 333-4444 10.0.0.1"), R.GENERAL_RULES)
    again = X.apply_rules(d.drop("counts"), R.GENERAL_RULES).first()
    assert again["text"] == d.first()["text"] == "[EMAIL] [NIK] [NO_HP] [IP]" and again["counts"] == {}


def test_second_pass_only_where_text_changed(spark):
    # two passes must equal running the six stages twice without the guard
    texts = [RECORD, "dr. Satu Duanama, dr. Tiga", "tanpa identitas  \n akhir"]
    stages = X.full_stages([])
    plain = frame(spark, *texts).withColumn("text", X.T.normalize("text"))
    for _ in range(2):
        plain = X.run_stages(plain, stages)
    expected = [r["text"] for r in plain.orderBy("id").collect()]
    assert [r["text"] for r in X.redact(frame(spark, *texts)).orderBy("id").collect()] == expected


def test_excuse_needs_the_label_within_80_characters(spark):
    d = X.scan_leftovers(frame(spark, "[DOKTER_UMUM] Sp.Rad", "[DOKTER_UMUM] " + "-" * 80 + " Sp.Rad", "Sp.Rad"))
    assert [r["leftovers"].get("leftover_sp", 0) for r in d.orderBy("id").collect()] == [0, 1, 1]


def test_compiled_and_joined_dictionary_agree(spark):
    staff = spark.createDataFrame(
        [("dr. Rekaan Satu Dua, Sp.N", ""), ("Contoh Namadia", "PERAWAT"), ("Contoh Namadia Panjang", "PERAWAT"), ("Uji O'Tes", "BIDAN")], "name string, role string"
    )
    variants = N.staff_variants(staff)
    docs = frame(
        spark, "oleh REKAAN  SATU-DUA dan contoh, namadia panjang.", "Contoh Namadiatidak", "uji o'tes; Satu Dua", "kosong", "Contoh Namadia Panjang, Contoh Namadia"
    )
    a = N.redact_staff(docs, variants, "id").orderBy("id").collect()
    b = N.redact_staff(docs, variants, "id", max_rows=1).orderBy("id").collect()
    assert [r["text"] for r in a] == [r["text"] for r in b]
    assert [dict(r["counts"]) for r in a] == [dict(r["counts"]) for r in b]
    assert a[0]["text"] == "oleh [DOKTER_SPESIALIS_NEUROLOGI] dan [PERAWAT]."
    assert a[1]["text"] == "Contoh Namadiatidak"


GLUED = [
    ("DPJP:Budi Santoso", "DPJP:[PERAWAT]"), ("perawat/Budi Santoso/", "perawat/[PERAWAT]/"), ("oleh(Budi Santoso)", "oleh([PERAWAT])"),
    ("'budi santoso'", "'[PERAWAT]'"), ("Budi Santoso's", "[PERAWAT]'s"), ("7Budi_Santoso7", "7[PERAWAT]7"), ("éBudi Santosoé", "é[PERAWAT]é"),
    ("ÉLAN PUTRI, élan putri", "[BIDAN], [BIDAN]"), ("oleh:Al-Amin Putra;", "oleh:[BIDAN];"), ("AL-AMIN, PUTRA", "[BIDAN]"), ("O'Tes-uji", "[BIDAN]"),
    ("Ana-Óz Éé, anaé óz", "[BIDAN], anaé óz"), ("(ÉÉÉ ÓÓÓ)", "([BIDAN])"), ("Budi/Santoso xBudi Santoso Budi Santosox", "Budi/Santoso xBudi Santoso Budi Santosox"), ("", ""), (None, None),
]


@pytest.mark.parametrize("max_rows", [1, 10_000])
def test_names_beside_marks_and_accents(spark, max_rows):
    names = [("Budi Santoso", "PERAWAT"), ("Élan Putri", "BIDAN"), ("Al-Amin Putra", "BIDAN"), ("O'Tes Uji", "BIDAN"), ("Ana-Óz Éé", "BIDAN"), ("Ééé Óóó", "BIDAN")]
    variants = spark.createDataFrame(names, "variant string, role string")
    docs = frame(spark, *(text for text, _ in GLUED))
    got = N.redact_staff(docs, variants, "id", max_rows=max_rows).orderBy("id").collect()
    assert [r["text"] for r in got] == [wanted for _, wanted in GLUED]


def test_factored_pattern_equals_plain_alternation():
    import re

    names = ["Ana Bela", "Ana Bela Cita", "Ana Bel", "Budi Ana", "Ana B-ela"]
    plain = "(?<![A-Za-z])(?:" + "|".join(N.variant_pattern(n) for n in sorted(names, key=len, reverse=True)) + ")(?![A-Za-z])"
    tree = N.alternation(names)
    for text in ["ana bela cita", "Ana Belax", "ana_bel, budi  ana bela", "xAna Bela", "ana b-ela cita"]:
        assert [m.span() for m in re.finditer(plain, text, re.I)] == [m.span() for m in re.finditer(tree, text, re.I)], text


def test_variants(spark):
    rows = N.staff_variants(spark.createDataFrame([("Prof. dr. Satu Dua Tiga Empat, Sp.PD, M.Kes", "X")], "name string, role string")).collect()
    assert {r["variant"] for r in rows} == {
        "Satu Dua Tiga Empat", "Satu Dua", "Satu Empat", "Satu Dua Empat", "Tiga Empat", "Satu Dua Tiga", "Dua Tiga Empat",
    }


def test_clinical_words_are_no_names(spark):
    assert N.staff_variants(spark.createDataFrame([("Stroke Infark", "X"), ("Foto Namadia", "X")], "name string, role string")).count() == 0


def test_page_edges(spark):
    text = "\n".join(["RS Uji", "a"] + ["isi"] * 20 + ["RS Uji", "b"] + ["isi"] * 12)
    row = X.mask_page_edges(frame(spark, text)).first()
    assert row["text"].count("[HEADER_FOOTER_RS]") == 2 and row["counts"]["header_footer_rs"] == 2


def test_not_a_name(one):
    assert one(L.is_not_name("text"), "Diagnosis Utama") and one(L.is_not_name("text"), "12-3") and one(L.is_not_name("text"), "ab")
    assert not one(L.is_not_name("text"), "Rekaan Namadia")


def test_review_lines_types(spark):
    d = L.review_lines(frame(spark, "surel a@b.cd\nRekaan Namadia, Amd.Kep\nno 123456"), ["id"])
    kinds = {r["type"] for r in d.collect()}
    assert {"EMAIL_MUNGKIN_BOCOR", "NAMA_DENGAN_GELAR_MUNGKIN_BOCOR", "NAMA_KAPITAL_MUNGKIN_BOCOR", "ANGKA_PANJANG_MUNGKIN_IDENTIFIER"} <= kinds
    ctx = d.filter("type = 'EMAIL_MUNGKIN_BOCOR'").first()["context"]
    assert ctx == ">> 1: surel a@b.cd\n   2: Rekaan Namadia, Amd.Kep"


def test_counts_merge(spark):
    d = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "x map<string,int>, y map<string,int>")
    assert d.select(X.merge_counts("x", "y").alias("m")).first()["m"] == {"a": 1, "b": 5}


def test_router_keeps_every_row(spark):
    d = frame(spark, "x" * 10, "y" * 100, None)
    rule = lambda c: [X.rules_stage([Rule("k", "[xy]", c, "")])]
    out = X.route_by_length(d, rule("s"), rule("l"), 50)
    assert sorted((r["id"], r["route"], (r["text"] or "")[:1], sum(r["counts"].values())) for r in out.collect()) == [
        (0, "short", "s", 10), (1, "long", "l", 100), (2, "short", "", 0)
    ]


OVERLAPS = [("Budi Santoso", "APOTEKER"), ("Budi Santoso Wijaya", "PERAWAT"), ("Citra Dewi", "PERAWAT")]
OVERLAP_TEXT = "visite oleh Budi Santoso Wijaya lalu Citra Dewi, obat dari Budi Santoso."


@pytest.mark.parametrize("max_rows", [1, 10_000])
def test_staff_dictionary_of_any_size(spark, max_rows):
    variants = spark.createDataFrame(OVERLAPS, "variant string, role string")
    docs = spark.createDataFrame([(1, OVERLAP_TEXT), (2, None), (3, "tanpa nama")], "id int, text string")
    got = {r["id"]: r["text"] for r in X.redact(docs, variants, key="id", max_rows=max_rows).collect()}
    assert got[1] == "visite oleh [PERAWAT] lalu [PERAWAT], obat dari [APOTEKER]." and got[3] == "tanpa nama"


def test_staff_dictionary_is_never_lost(spark):
    docs = spark.createDataFrame([(1, OVERLAP_TEXT)], "id int, text string")
    variants = spark.createDataFrame(OVERLAPS, "variant string, role string")
    with pytest.raises(ValueError):
        X.redact(docs, N.compile_staff(variants, 1))
    with pytest.raises(ValueError):
        X.redact(docs, variants, max_rows=1)


@pytest.mark.parametrize("repeat", [1, 900])
def test_identities_go_at_every_length(spark, repeat):
    text = "keluhan pusing berkurang, makan baik.\n" * repeat + "No. RM: 00123 NIK 3273012345678901 hp 081234567890 a@b.cd\n"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    out = X.route_by_length(docs, X.full_stages([]), X.light_stages([])).first()
    assert out["route"] == ("long" if repeat > 1 else "short")
    assert not any(x in out["text"] for x in ("00123", "3273012345678901", "081234567890", "a@b.cd"))


def test_needles_are_sought_in_a_text_lowered_once(spark):
    import time

    rules = [Rule(f"k{i}", rf"\bzq{i}\w+", f"[Z{i}] zq{i + 1}x", needles=(f"zq{i}", f"zr{i}", f"zs{i}", f"zt{i}")) for i in range(40)]
    d = spark.range(40).repartition(4).select("id", F.concat(F.repeat(F.lit("Kéluhan püsing berkurang, makan baik.\n"), 25_000), F.when(F.col("id") == 7, "ZQ0X").otherwise("")).alias("text"))
    start = time.time()
    got = {r["id"]: r for r in X.apply_rules(d, rules).select("id", F.substring("text", -30, 30).alias("end"), "counts").collect()}
    # each rule sees what its predecessor wrote, in either case
    assert got[7]["end"].endswith("[Z39] zq40x") and got[7]["counts"] == {f"k{i}": 1 for i in range(40)} and got[8]["counts"] == {}
    assert time.time() - start < 30


def test_line_review_seeks_only_the_wanted_kinds(spark):
    d = frame(spark, "Budi Santoso\nmail a@rs.example.id\ndr. Siti Aminah, 1234567890123456", "dokter Rina Wati")
    whole = {tuple(r) for r in L.review_lines(d, ["id"]).collect()}
    kind = "NAMA_KAPITAL_MUNGKIN_BOCOR"
    assert {tuple(r) for r in L.review_lines(d, ["id"], kinds=[kind]).collect()} == {r for r in whole if kind in r} != set()
    with pytest.raises(ValueError):
        L.review_lines(d, ["id"], kinds=["x"])
