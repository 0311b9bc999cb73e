import json
import random

import pytest
from pyspark.sql import functions as F

from notewarden.operators import merge as M, redact as X
from notewarden import rules as R
from notewarden.skew import assign_sequence, concat_parts, running_total
from notewarden.sources import documents as D, profiles as P
from notewarden.streaming import incremental as I


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "p1").mkdir(parents=True)
    (tmp_path / "in" / "p2").mkdir()
    (tmp_path / "in" / "p1" / "resume.txt").write_bytes("Umur: 50 Tahun\r\nkeluhan lemah, surel a@b.cd".encode())
    (tmp_path / "in" / "p1" / "pendek.txt").write_text("x")
    (tmp_path / "in" / "p2" / "lab_1.txt").write_bytes("Hemoglobin 10 g/dL é panjang sekali".encode("latin-1"))
    return tmp_path


def test_folder_scan_and_sinks(spark, folder):
    docs = D.patient_files(D.with_path_keys(D.read_text_folder(spark, str(folder / "in"))))
    rows = {(r["patient_id"], r["source_file"], r["doc_type"]) for r in docs.collect()}
    assert rows == {("p1", "p1/resume.txt", "resume"), ("p2", "p2/lab_1.txt", "lab")}
    out = X.apply_rules(docs, R.GENERAL_RULES)
    D.write_redacted(out, str(folder / "red"))
    back = spark.read.parquet(str(folder / "red"))
    assert {r["output_file"] for r in back.collect()} == {"p1/resume.anon.txt", "p2/lab_1.anon.txt"}
    assert not back.filter(F.col("text").contains("a@b.cd")).count()
    D.write_csv(out.select("patient_id", "source_file"), str(folder / "csv"), ["source_file"])
    assert spark.read.csv(str(folder / "csv"), header=True).columns == ["source_file"]
    D.write_bundle({"audit": out.select("patient_id", "counts"), "log": out.select("patient_id")}, str(folder / "bundle"))
    assert spark.read.parquet(str(folder / "bundle" / "audit")).count() == 2
    D.write_json(out.select("patient_id"), str(folder / "json"))
    assert spark.read.json(str(folder / "json")).count() == 2


def test_flat_folder_is_one_patient(spark):
    d = D.with_path_keys(spark.createDataFrame([("a.txt",), ("p/b.txt",)], "path string"), root="akar")
    assert [r["patient_id"] for r in d.collect()] == ["akar", "p"]


def test_patient_discovery(spark):
    d = spark.createDataFrame([("a",), ("a/x",), ("b/x",), ("c/x",), ("c/y",), ("c/y",)], "folder string")
    assert {r[0] for r in D.discover_patients(d).collect()} == {"a", "b", "c/x", "c/y"}


def test_staff_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿name,role\n dr. Uji Coba ,\nSiti Contoh,BIDAN\n".encode())
    rows = [(r["name"], r["role"]) for r in D.read_staff_csv(spark, str(tmp_path / "s.csv")).collect()]
    assert rows == [("dr. Uji Coba", ""), ("Siti Contoh", "BIDAN")]
    both = D.union_staff(D.read_staff_csv(spark, str(tmp_path / "s.csv")), spark.createDataFrame([("Lain Nama", None)], "name string, role string"))
    assert ("Lain Nama", "PPA") in {(r["name"], r["role"]) for r in both.collect()}


def test_answers(one):
    schema = "k long"
    for text in ['```json\n{"k": 1}\n```', 'kata {"k": 1} akhir', '{"k": 1}']:
        assert one(D.parse_answer("text", schema), text)["k"] == 1


def write(folder, name, body):
    (folder / name).write_text(json.dumps(body))


def test_profiles(tmp_path):
    write(tmp_path, "uji.json", {
        "name": "Penyakit Uji", "field_types": {"hb": "numeric"}, "drug_profile": "d.json", "categories": {
            "R": {"type": "regex", "fields": ["hb", "x"], "doc_types": ["lab"], "patterns": {"hb": "hb (\\d+)", "x": {"pattern": "y.*z", "dotall": True, "doc_types": ["resume"]}}},
            "K": {"type": "keyword", "fields": ["d"], "keywords": {"d": ["demam"]}}, "B": {"type": "builtin", "extractor": "gcs", "fields": ["gcs"]}, "N": {"type": "none", "fields": ["n"]}}})
    write(tmp_path, "_template.json", {"categories": {}})
    assert [p["file"] for p in P.list_profiles(tmp_path)] == ["uji.json"]
    for wanted in ("uji.json", "uji", "penyakit UJI"):
        assert P.load_profile(tmp_path, wanted).fields == ["hb", "x", "d", "gcs", "n"]
    p = P.load_profile(tmp_path, "uji")
    assert p.categories[0].regex[0].doc_types == ("lab",) and p.categories[0].regex[1].dotall and p.categories[0].regex[1].doc_types == ("resume",)
    assert [c.name for c in P.select(p, ["K"]).categories] == ["K"] and P.select(p, []).categories == []
    assert P.select(p, None, {"R": ["x"]}).categories[0].regex[0].field == "x"
    with pytest.raises(FileNotFoundError):
        P.load_profile(tmp_path, "tiada")
    with pytest.raises(ValueError):
        P.parse_profile({"name": "x"})


def test_category_overlay():
    merged = P.overlay_categories({"A": {"fields": ["x"], "extractor": "e"}}, {"A": {"fields": ["y"], "extractor": "z"}, "B": {"fields": []}})
    assert merged["A"] == {"fields": ["y"], "extractor": "e"} and "B" in merged


def test_drugs(tmp_path):
    write(tmp_path, "d.json", {"_note": "x", "med_a": ["baru"], "med_b": [], "med_c": ["c"]})
    got = P.load_drugs(tmp_path / "d.json", {"med_a": ["lama"], "med_b": ["b"]})
    assert got == {"med_a": ["baru"], "med_b": ["b"], "med_c": ["c"]}
    assert P.load_drugs(tmp_path / "tiada.json") == {}
    assert P.orphan_drug_fields(["med_a", "med_a_dosis", "med_z", "umur"], got) == ["med_z"]


def test_pathways(tmp_path):
    write(tmp_path, "cp.json", {"name": "CP Uji", "disease_profile_ref": "penyakit_uji", "los_target": {"min": 0, "max": 3}, "standards": {"S": [{"field": "a", "expected": "ada"}, {"field": "b", "expected": 5}, {"field": "c", "expected": "Ya"}]}})
    for wanted in ("cp", "cp uji", "Penyakit Uji"):
        name, items, target = P.load_pathway(tmp_path, wanted)
        assert [s.kind for s in items] == ["ada", "numeric", "string"] and target.low == 0
    assert P.list_pathways(tmp_path)[0]["standards_count"] == 3


def test_sequence_and_totals_with_a_hot_key(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", f"f{rnd.random():.9f}", rnd.randint(1, 9)) for _ in range(500)]
    d = spark.createDataFrame(rows, "k string, f string, v int")
    seq = {(r["k"], r["f"]): r["doc_seq"] for r in assign_sequence(d, ["k"], ["f"], partitions=7).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for i, f in enumerate(sorted(r[1] for r in rows if r[0] == k)):
            want[(k, f)] = i
    assert seq == want
    numbered = spark.createDataFrame([(k, want[(k, f)], v) for k, f, v in rows], "k string, o long, v int")
    got = {(r["k"], r["o"]): r["running"] for r in running_total(numbered, ["k"], "o", F.col("v"), span=16).collect()}
    for k in {r[0] for r in rows}:
        total = 0
        for o, v in sorted((want[(a, f)], v) for a, f, v in rows if a == k):
            total += v
            assert got[(k, o)] == total


def test_concat_parts_rebuild_the_whole(spark):
    d = spark.createDataFrame([("k", i, str(i)) for i in range(25)], "k string, o long, t string")
    parts = concat_parts(d, ["k"], "o", F.col("t"), ",", part_bytes=15).orderBy("part").collect()
    assert len(parts) == 3 == parts[0]["n_parts"] and [p["part"] for p in parts] == [0, 1, 2] and ",".join(p["text"] for p in parts) == ",".join(str(i) for i in range(25))


def test_concat_is_one_row_when_it_fits(spark):
    rows = [(k, i * 10**9, f"{k}{i}") for k in ("a", None) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, o long, t string")
    got = {r["k"]: r for r in concat_parts(d, ["k"], "o", F.col("t"), ",").collect()}
    assert got["a"]["text"] == ",".join(f"a{i}" for i in range(300)) and got["a"]["n_parts"] == 1
    assert got[None]["text"] == ",".join(f"None{i}" for i in range(300)) and len(got) == 2


def test_merge_rejects_batches_without_key(spark):
    a = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        M.merge_batches(a, a, ["patient_id"], ["x"])


def test_stream_reads_only_new_files(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string").write.parquet(str(src / "1"))
    schema = spark.read.parquet(str(src / "1")).schema

    def run():
        stream = I.read_new_files(spark, str(src / "*"), schema)
        I.redact_new(stream, lambda d: X.apply_rules(d, R.GENERAL_RULES), out, out + "_state", ["doc_id"])

    run()
    spark.createDataFrame([(2, "bersih")], "doc_id long, text string").write.parquet(str(src / "2"))
    run()
    run()
    rows = {(r["doc_id"], r["batch_id"]): dict(r["counts"]) for r in spark.read.parquet(out + "/audit").collect()}
    assert rows == {(1, 0): {"email": 1}, (2, 1): {}}


def test_latest_rows_and_compaction(spark, tmp_path):
    src, out = tmp_path / "s", str(tmp_path / "o")
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 0)]]):
        spark.createDataFrame(rows, "id int, v string, o int").coalesce(1).write.parquet(str(src / str(n)))
        stream = I.read_new_files(spark, str(src / "*"), spark.read.parquet(str(src / "0")).schema)
        I.append_batches(stream, out, out + "_state")
    assert {(r["id"], r["v"]) for r in I.latest_rows(spark, out, ["id"], ["o"]).collect()} == {(1, "c"), (2, "b")}
    I.compact(spark, out, str(tmp_path / "c"), ["id"], ["o"])
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_a_table_as_file_or_folder_is_read_as_new_files(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "k int, text string")
    d.repartition(3).write.parquet(str(tmp_path / "in/folder.parquet"))
    d.limit(2).toPandas().to_parquet(tmp_path / "in/file.parquet")
    for name, n in (("folder.parquet", 6), ("file.parquet", 2)):
        out = str(tmp_path / name)
        I.append_batches(I.read_new_files(spark, str(tmp_path / "in"), d.schema, glob=name), out, str(tmp_path / f"state-{name}"))
        assert spark.read.parquet(out).count() == n


def test_small_files_are_spread_in_parts_of_bounded_size(spark, monkeypatch):
    from notewarden.plans import registry

    t = registry.Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 5)
    sizes = [len(p) for p in t.spread("customer").select("c_custkey").rdd.glom().collect()]
    assert sum(sizes) == t.customer.count() and len(sizes) == 30 and max(sizes) <= 10
    # a table of enough splits is read as it is
    monkeypatch.setattr(registry, "TASKS_PER_CORE", 0)
    assert t.spread("customer").rdd.getNumPartitions() == t.customer.rdd.getNumPartitions()


def test_concat_of_a_large_group_is_one_row(spark):
    d = spark.range(70).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.repeat(F.chr(F.col("id") + 40), 1_000_000).alias("t"))
    got = concat_parts(d, ["k"], "o", F.col("t"), "\n").select("part", "n_parts", "n_items", F.length("text").alias("n"), F.substring("text", 1_000_000, 3).alias("cut")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 70, 70_000_069, "(\n)")]
