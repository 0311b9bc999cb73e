"""Failing rows, result folders, rule catalogues, dictionaries of any size, neighbours
with nulls, later categories."""

import json
import random

import pytest
from pyspark.sql import functions as F

from notewarden import skew
from notewarden.operators import audit as A, extract as E, isolate as S
from notewarden.operators.profile_run import run_profile
from notewarden.sources import profiles as P, results as W
from notewarden.sources.profiles import Category, Profile


def steps():
    return [
        S.Step("raw", lambda: S.strict_text("content"), "bytes"),
        S.Step("body", lambda: S.strict_json("raw", "a int, b string"), "json"),
        S.Step("day", lambda: F.try_to_date(F.col("body.b"), "yyyy-MM-dd"), "date", lambda: F.col("body.b").isNull()),
    ]


def test_first_failure_of_each_row(spark):
    cases = [
        (b'{"a": 1, "b": "2026-05-03"}', None), (b"\xff\xfe", "bytes"), (b'{"a": 1', "json"), (b'{"a": "x"}', "json"), (b'{"a": 1, "b": "2026-02-31"}', "date"),
        (b'{"a": 1}', None), (None, "bytes"), (b"", "json"), (b'\xef\xbb\xbf{"a": 2}', None), (b"[]", "json"),
    ]
    d = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "id int, content binary")
    got = {r["id"]: r for r in S.run_steps(d, steps()).collect()}
    # an empty array is read as a null object
    assert [got[i]["error"] for i in range(len(cases))] == [e for _, e in cases]
    assert got[1]["body"] is None and got[2]["day"] is None


def test_result_rows_keep_every_file(spark):
    d = spark.createDataFrame([("a.txt", "new", {"k": 2}, {"l": 1}, None), ("b.txt", None, None, None, "bytes"), ("c.txt", "", {}, {}, None)], "source_file string, text string, counts map<string,int>, leftovers map<string,int>, error string")
    got = {r["source_file"]: r for r in S.result_rows(d).collect()}
    assert got["b.txt"]["extraction_status"] == "error" and got["b.txt"]["needs_manual_review"] and got["b.txt"]["counts"] == {} and got["b.txt"]["output_file"] == ""
    assert got["a.txt"]["needs_manual_review"] and got["a.txt"]["counts"] == {"k": 2} and not got["c.txt"]["needs_manual_review"]


def test_results_folder(spark, tmp_path):
    out = str(tmp_path / "r")
    d = spark.createDataFrame([("a", "x", None), ("b", None, "broken"), (None, "n", None)], "source_file string, text string, error string")
    W.write_results(d, out, "1", "source_file")
    W.write_results(d.filter("source_file = 'a'").withColumn("source_file", F.lit("z")), out, "2", "source_file")
    W.write_results(d, out, "1", "source_file")
    index = sorted(((r["run_id"], r["source_file"], r["status"], r["error"], r["file"] != "") for r in W.read_index(spark, out).collect()), key=repr)
    assert index == sorted([("1", "a", "ok", "", True), ("1", "b", "error", "broken", False), ("1", None, "ok", "", True), ("2", "z", "ok", "", True)], key=repr)
    (tmp_path / "r/data/run_id=3").mkdir()
    (tmp_path / "r/data/run_id=3/part.json").write_text('{"source_file": "cut short", "text": "t"}')
    assert sorted((r["run_id"], r["text"]) for r in W.read_results(spark, out, "source_file string, text string").collect()) == [("1", "n"), ("1", "x"), ("2", "x")]


def test_audit_csv_has_the_keys_of_the_data(spark, tmp_path):
    d = spark.createDataFrame([("a", {"x": 1}, {"z": 0}), ("b", None, {"y": 4})], "source_file string, counts map<string,bigint>, leftovers map<string,bigint>")
    assert W.write_audit_csv(d, str(tmp_path / "c")) == ["source_file", "x", "y", "z"]
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1", "0", "0"), ("b", "0", "4", "0")]
    with pytest.raises(ValueError):
        A.count_keys(spark.createDataFrame([({str(i): 1 for i in range(5)},)], "counts map<string,int>"), limit=4)


def test_rule_files_by_every_kind_of_name(tmp_path, spark):
    files = {"a.json": {"name": "b", "standards": {}}, "b.json": {"name": "x", "disease_profile_ref": "Deep Vein", "standards": {"S": []}}, "c.json": {"name": "Deep_Vein", "standards": {}}}
    for wanted, file in (("b", "b.json"), ("B", "a.json"), ("deep vein", "b.json"), ("deep_vein", "c.json"), ("a.json", "a.json")):
        assert P.find_rules(files, wanted) is files[file], wanted
    with pytest.raises(FileNotFoundError):
        P.find_rules(files, "none")
    asked = spark.createDataFrame([("b",), ("B",), ("deep vein",), ("deep_vein",), ("a.json",), ("none",), (None,)], "disease string")
    got = {r["disease"]: r["file"] for r in P.match_pathways(asked, P.catalogue_frame(spark, files)).collect()}
    assert got == {"b": "b.json", "B": "a.json", "deep vein": "b.json", "deep_vein": "c.json", "a.json": "a.json"}
    (tmp_path / "p.json").write_text(json.dumps({"name": "n", "disease_profile_ref": "r", "categories": {}}))
    with pytest.raises(FileNotFoundError):
        P.load_profile(tmp_path, "r")


@pytest.mark.parametrize("word_boundary", [False, True])
def test_dictionary_of_any_size(spark, word_boundary):
    rnd = random.Random(3)
    words = ["asam", "asa", "as", "mefenamat", "x+y", "a.b", "parasetamol", "setam", "b", "q\\Ez", "obat [a]"]
    docs = [(f"p{i % 5}", f"f{i:02d}", " ".join(rnd.choice([*words, "500mg/8 jam", "selama 5 hari", "Asam", "lain"]) for _ in range(rnd.randint(0, 12)))) for i in range(40)] + [("p9", "f", None), ("p8", "f", "")]
    d = spark.createDataFrame(docs, "patient_id string, source_file string, text string")
    drugs = {"med_a": words[:5], "med_b": words[5:], "med_c": ["tiada"], "other": ["asam"]}
    rows = lambda **k: sorted(tuple(r) for r in E.medications(d, drugs, word_boundary=word_boundary, **k).collect())
    assert rows(max_terms=1) == rows()
    table = spark.createDataFrame([(k, i, t) for k, v in drugs.items() for i, t in enumerate(v)], "drug_key string, term_pos int, term string")
    assert sorted(tuple(r) for r in E.medications(d, table, word_boundary=word_boundary).collect()) == rows()


def test_labelled_matches(spark):
    d = spark.createDataFrame([(1, "ab 12 cd 345\nx 6"), (2, None), (3, "none")], "id int, text string")
    got = sorted(tuple(r) for r in E.labelled_matches(d, {"N": r"\d+", "W": "[a-d]+"}, ["id"], radius=3, limit=2).collect())
    assert got == [(1, "N", 1, 3, "12", "ab 12 cd"), (1, "N", 2, 9, "345", "cd 345 x"), (1, "W", 1, 0, "ab", "ab 12"), (1, "W", 2, 6, "cd", "12 cd 34")]


@pytest.mark.parametrize("dense", [False, True])
def test_neighbours_with_null_keys_and_sparse_orders(spark, dense):
    rows = [("p", 1, ["a"]), ("p", 9_000_000_000, ["b"]), ("p", None, ["n"]), (None, 1, ["x"]), (None, 7, ["y"]), ("p", 40_000, ["c"])]
    d = spark.createDataFrame(rows, "k string, o long, w array<string>")
    got = {(r["k"], r["o"]): (r["items_before"], r["items_after"]) for r in skew.neighbour_items(d, ["k"], "o", "w", "w", 2, span=4, dense=dense).collect()}
    assert got == {
        ("p", None): ([], ["a", "c"]), ("p", 1): (["n"], ["c", "b"]), ("p", 40_000): (["n", "a"], ["b"]), ("p", 9_000_000_000): (["a", "c"], []),
        (None, 1): ([], ["y"]), (None, 7): (["x"], []),
    }


def test_later_category_wins(spark):
    d = spark.createDataFrame([("p", "f", "resume", "A: 10 B: 9"), ("q", "f", "resume", "A: 3")], "patient_id string, source_file string, doc_type string, text string")
    rule = lambda p: [E.FieldRule("v", p + r":\s*(\d+)")]
    one, two = Category("x", "regex", ["v"], regex=rule("A")), Category("y", "regex", ["v"], regex=rule("B"))
    unlisted = Category("z", "regex", [], regex=rule("A"))
    for categories, want in (([one, two], {"p": "9", "q": "3"}), ([two, one], {"p": "10", "q": "3"}), ([two, unlisted], {"p": "9", "q": "3"}), ([unlisted, two], {"p": "9", "q": "3"})):
        wide = run_profile(d, Profile("t", [*categories, Category("w", "regex", ["v2"])]), wide=True)
        assert {r["patient_id"]: r["v"] for r in wide.collect()} == want
        long = run_profile(d, Profile("t", categories))
        if len([c for c in categories if c.fields]) == 2:
            assert {r["patient_id"]: r["value"] for r in long.collect()} == want


def test_mail_addresses_in_either_case(spark):
    from notewarden.operators import redact as X
    from notewarden.plans.run_queries import RULES

    cases = {"John.Doe@Example.COM 7": "[SUREL] [ANGKA]", "A@B": "[SUREL]", "ſam@Kelvin.org": "[SUREL]", "ıx@İy.z": "ıx@İy.z", "Ü.x@Ä.de": "Ü.x@Ä.de"}
    d = X.apply_rules(spark.createDataFrame([(k, k) for k in cases], "id string, text string"), RULES)
    assert {r["id"]: r["text"] for r in d.collect()} == cases


def test_joined_drug_dictionary_reads_a_long_text_once(spark):
    import time

    text = "".join(f"w{i} " for i in range(60_000)) + "hein 500mg"
    d = spark.createDataFrame([("p", 1, text)], "patient_id string, doc_id int, text string")
    start = time.time()
    got = {r["drug_key"]: (r["value"], r["dose"]) for r in E.medications(d, {"med_a": ["hein"], "med_b": ["xy"]}, order="doc_id", max_terms=1).collect()}
    assert got == {"med_a": ("ada", "hein 500mg"), "med_b": ("tidak", "")}
    assert time.time() - start < 20
