"""What is left out of a chain is what the chain would not have changed."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from notewarden import rules as R
from notewarden.functions import text as T
from notewarden.operators import names as N, redact as X, token_pairs, untouched as U

PIECES = [
    "No. RM", "No", "RM", "Rekam", "Medis", ":", " ", "\n", "\n\n", ",", ".", "-", "12-34-56-78", "NIK", "3273012000000001", "SEP", "No Reg", "AB123", "Lab",
    "Accession No", "0812345678", "+62812 345 67", "08", "1", "a.b@x.id", "@", "Tgl Lahir", "1/2/2020", "Nama Pasien", "Nama", "Budi Santoso", "Suami", "Alamat",
    "Jl. Mawar 5 Bandung", "RS Umum", "Rumah", "Sakit", "S", "B:", "Telp", "(022) 12345", "diverifikasi oleh", "DPJP", "Dokter Jaga", "dr", "dr.", "drg.", "Dr. ",
    "Sp.N", "Sp", "H.", "Hj", "Ns.", "Ners", "S.", "Kep", "Amd.Kep", "AMK", "Bd.", "apt.", "Farm", "Apt", "Analis", "Radiografer", "Gizi", "Md", "Rad", "Fis",
    "[DOKTER]", "[NIK]", "[PERAWAT_X]", "[", "]", "print copy by", "print copy ke-2 by :", "01/02/2020\n10:00\n", "\nS\n", "\nO\n", "Print Copy", "No. Foto", "Unit Asal",
    "Halaman", "é", "ß", "\x0b", "\t", "  ", "\r\n", " ", "_", "x", "Kſ", "keluhan pusing berkurang, makan baik.\n", "Siti Rahayu\n", "Wati Nurhayati binti Hadi Kusumo Wardani\n",
]
ALL = R.IDENTITY_RULES + R.DOCTOR_RULES + R.STAFF_RULES + [R.NOTE_HEADER] + R.CLEANUP_RULES + R.LEFTOVER_RULES + R.DASHED_NUMBER_RULES + R.ADMIN_LINE_RULES + R.LIGHT_STAFF_RULES + R.SPLIT_LINE_RULES


def texts(seed, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_every_match_holds_a_trigger(spark):
    sample = texts(1, 6000, 9)
    d = spark.createDataFrame([(t,) for t in sample], "text string")
    hits = d.select("text", *[F.col("text").rlike(r.java).alias(f"r{i}") for i, r in enumerate(ALL)]).toArrow()
    for i, rule in enumerate(ALL):
        found = pc.match_substring_regex(hits["text"], U.trigger(rule))
        missed = pc.and_(hits[f"r{i}"], pc.invert(found))
        assert not pc.any(missed).as_py(), (rule.key, hits["text"].filter(missed).to_pylist()[:3])


def test_counts_of_lines():
    assert U.lines_above([]) == 2 and U.lines_above(R.DASHED_NUMBER_RULES) == 2
    assert U.lines_above([R.DOCTOR_RULES[4]]) == 2 + 1 + 1 + 3  # a name, a name, three times


def test_parts_make_the_text(spark):
    inert = "keluhan pusing berkurang, makan baik.\n" * 40
    rows = [(0, None), (1, ""), (2, inert), (3, inert + "NIK 3273012000000001"), (4, "NIK 3273012000000001" + inert), (5, "é" + inert + "a@b.id"), (6, "x\n" * 50 + "a@b.id")]
    d = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: r["p"] for r in d.select("id", U.parted(F.col("text"), R.IDENTITY_RULES, F.lit(5)).alias("p")).collect()}
    assert got[0]["above"] is None and got[0]["rest"] is None
    assert all(got[i]["above"] + got[i]["rest"] == t for i, t in rows if t is not None)
    assert got[2]["rest"] == "" and got[4]["above"] == "" and got[6]["above"] == ""
    assert got[3]["rest"] == inert[: len(inert) // 40 * 5] + "NIK 3273012000000001" and got[5]["above"].startswith("é")


def test_routes_equal_the_whole_chains(spark):
    rnd = random.Random(5)
    inert = ["keluhan pusing berkurang, makan baik.\n", "tekanan darah membaik dan nafsu makan cukup\n", "\n", "tetap\n"]
    rows = [(i, "".join(rnd.choices(inert, k=rnd.randint(0, 60))) + t + "".join(rnd.choices(inert, k=rnd.randint(0, 5)))) for i, t in enumerate(texts(2, 800, 25))]
    d = spark.createDataFrame(rows, "id int, text string").withColumn("text", T.normalize("text")).localCheckpoint()
    short, long = X.full_stages([]), X.light_stages(X.literal_rules(["Bidan Mawar"], "[BIDAN]", "STAFF_EXACT_BIDAN", 5))
    got = X.route_by_length(d, short, long, limit=700)
    size = F.length("text")
    want = X.run_stages(d.filter(size <= 700), short).unionByName(X.run_stages(d.filter(size > 700), long))
    a = {r["id"]: (r["text"], r["counts"]) for r in got.collect()}
    b = {r["id"]: (r["text"], r["counts"]) for r in want.collect()}
    assert a == b and sum(bool(c) for _, c in a.values()) > 500


def test_little_is_left_to_the_chain(spark):
    """A long text with identities at its end is not searched as a whole."""
    inert = "keluhan pusing berkurang, makan baik.\n" * 700
    rules = X.rules_of(X.light_stages([]))
    d = spark.createDataFrame([(inert + "NIK 3273012000000001",)], "text string")
    assert len(d.select(U.parted(F.col("text"), rules, F.lit(U.lines_above(rules))).alias("p")).first()["p"]["rest"]) < 1500


def test_normalize_brute_force(spark):
    sample = texts(3, 3000, 6)
    d = spark.createDataFrame([(t,) for t in sample], "text string").select("text", T.normalize("text").alias("n"))
    for r in d.collect():
        assert r["n"] == re.sub("[ \t]+", " ", r["text"].replace("\r\n", "\n").replace("\r", "\n").replace(" ", " "))


def staff(spark):
    names = ["dr. Budi Mirza Nurhadi, Sp.N", "drg. Siti Édna", "Ælfrida Ÿsolde Kusumo", "Wati Nur-Hayati"]
    return N.staff_variants(spark.createDataFrame([(n, "PERAWAT" if i > 1 else "") for i, n in enumerate(names)], "name string, role string"))


def test_token_pairs_against_a_plain_loop():
    fold = str.maketrans(N.CAPITALS, N.SMALL)
    rnd = random.Random(1)

    def pairs(t):
        words = re.findall(N.NAME_TOKEN, t.translate(fold))
        return ["", *words, *map(" ".join, zip(words, words[1:]))]

    for trial in range(200):
        texts_ = ["".join(rnd.choice("abcXYZé ÉßŸÿ÷×  .,-\nñΩK") for _ in range(rnd.randint(0, 12))) for _ in range(20)] + [None]
        every = sorted({p for t in texts_[:5] for p in pairs(t)} - {""})
        known = rnd.sample(every, min(3, len(every))) + ([""] if trial % 10 == 0 else [])
        hashes = token_pairs.pair_hash(pa.array(known, pa.string())).to_numpy()
        assert len(set(hashes.tolist())) == len(known)
        got = token_pairs.holds_pair(pa.array(texts_), hashes).to_pylist()
        assert all(g or not set(pairs(t)) & set(known) for t, g in zip(texts_[:20], got))
        # alone, so that the last token has no neighbour in the next text
        assert all(token_pairs.holds_pair(pa.array([t]), hashes).to_pylist() == [bool(set(pairs(t)) & set(known))] for t in texts_[:3])


def test_redaction_is_the_same_with_texts_left_out(spark):
    variants = staff(spark).localCheckpoint()
    said = ["Budi Mirza", "MIRZA, NURHADI", "siti édna", "Ælfrida\nŸsolde", "ÆLFRIDA ŸSOLDE", "Wati Nur Hayati", "Budi", "Édna", "nurhadi"]
    rnd = random.Random(9)
    rows = [(i, t + rnd.choice(["", rnd.choice(said), "x" + rnd.choice(said), rnd.choice(said) + "é"])) for i, t in enumerate(texts(4, 250, 3) + texts(6, 50, 25))]
    rows += [(900, None), (901, ""), (902, "tetap\n"), (903, "tetap \nsaja")]
    d = spark.createDataFrame(rows, "id long, text string").localCheckpoint()
    rules = N.compile_staff(variants)
    plain = d.withColumn("text", T.normalize("text"))
    for number in range(2):
        plain = X.run_stages(plain, X.full_stages(rules)).localCheckpoint()
    want = {r["id"]: r.asDict() for r in X.scan_leftovers(plain).collect()}
    for got in (X.redact(d, variants), X.redact(d, variants, key="id", max_rows=1)):
        assert {r["id"]: r.asDict() for r in got.collect()} == want
    assert sum(any(k.startswith("staff_csv") for k in r["counts"]) for r in want.values()) > 30


def test_texts_left_out_meet_no_name_join(spark, monkeypatch):
    """Only texts with a place for a rule or a pair of name words go through the joins."""
    seen = []
    join = N.redact_staff_join

    def counted(docs, *rest):
        seen.append(docs.count())
        return join(docs, *rest)

    monkeypatch.setattr(N, "redact_staff_join", counted)
    d = spark.createDataFrame([(i, "tetap saja" if i else "lapor Budi Mirza Nurhadi") for i in range(50)], "id long, text string")
    assert X.redact(d, staff(spark), key="id", max_rows=1).count() == 50 and seen == [1, 1]
