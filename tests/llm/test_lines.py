"""Line removal against a plain version."""

import collections

import pytest
from .helpers import corpus, prose
from pyspark.sql import functions as F

from notewarden.llm import line_dedup

import numpy as np

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_chars=10, min_docs=2):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add((doc is None, doc or 0))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= min_chars and len(holders[key_of(x)]) >= min_docs and min(holders[key_of(x)]) != (doc is None, doc or 0))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined(seed=1):
    rng = np.random.default_rng(seed)
    shared = [prose(rng, 6) for _ in range(30)] + ["  Common Footer line\t", "COMMON FOOTER LINE", "ÉCOLE du Nord et Sud", "école du Nord et Sud", "short", "exactly10c", "nine char", " padded by other space "]
    rows = [(i, "\n".join(shared[int(k)] if k < len(shared) else prose(rng, 5) for k in rng.integers(0, 60, int(rng.integers(1, 40))))) for i in range(80)]
    return rows + [(3, rows[3][1]), (3, "Common footer line\nother text of three"), (None, rows[5][1]), (None, "nulls own line here"), (91, ""), (92, None), (93, "\n\n\n"), (94, "exactly10c\r\nexactly10c"), (95, "\nexactly10c\n")]


def run(spark, rows, **options):
    got = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_against_plain(spark, min_docs):
    assert run(spark, lined(), min_docs=min_docs) == plain(lined(), min_docs=min_docs)


def test_corpus_of_copies(spark):
    rows = [(d, (t or "").replace(" w1", "\nw1") if t is not None else None) for d, t in corpus()]
    assert run(spark, rows) == plain(rows)


def test_hot_line_and_long_document(spark):
    """One line in every document and many times in one; a document of many lines of which every second goes."""
    rows = [(i, f"the very common line\nline of document {i}\nthe very common line") for i in range(400)]
    rows.append((1000, "\n".join(f"line of document {i % 400}\nkept line number {i}" for i in range(20_000))))
    assert run(spark, rows) == plain(rows)


def test_one_row_for_each_input_row_and_the_last_cut(spark):
    rows = [(1, "a line that is shared"), (2, "a line that is shared"), (2, "a line that is shared"), (3, "x\na line that is shared")]
    assert run(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([(1, "one shared line", 5), (2, "one shared line", 6)], "doc_id long, text string, pos int")
    clash = docs.withColumns({"k": F.lit("k"), "th": F.lit(1), "h1": F.lit(2), "N_Dropped": F.lit(9), "cuts": F.lit("c"), "line": F.lit("l"), "n": F.lit(3)})
    got = line_dedup.drop_shared_lines(clash).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["pos"], r["k"], r["cuts"], r["n_dropped"], r["kept"]) for r in got] == [(1, 5, "k", "c", 0, "one shared line"), (2, 6, "k", "c", 1, "")]


def test_main_path_is_native(spark):
    docs = spark.createDataFrame(lined(), "doc_id long, text string")
    plan = line_dedup.drop_shared_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
