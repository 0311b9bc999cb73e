"""Each stage against its brute-force version on a small corpus."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from notewarden.llm.queries import WORD_VOCABULARY

from .helpers import corpus, hit_words, prose, similar_components, without_repeats

ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(9)
    rows = corpus() + [(200, ITEMS[0][1]), (201, prose(rng, 50, 4000) + " " + ITEMS[0][1])]
    rows += [(300 + i, "!! ".join(prose(rng, 80, 4000).upper().split())) for i in range(20)] + [(400 + i, prose(rng, 80, 4000)) for i in range(200)]
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [f for _, f in P.STAGES]
    kept = names[0](spark, docs, folder)
    ids = {d for d, _ in rows_of(kept)}
    assert kept.columns == docs.columns and not ids & set(range(300, 320)) and len(ids & set(range(400, 600))) > 190
    one = names[1](spark, docs, folder)
    want = {c for (_, n, c) in similar_components(rows_of(docs)) if n} | {d for d, n, _ in similar_components(rows_of(docs)) if not n}
    assert {d for d, _ in rows_of(one)} == want and one.columns == docs.columns
    cut = names[2](spark, docs, folder)
    texts = without_repeats([t for _, t in rows_of(docs)])
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=repr) == sorted(((d, w[3].decode("utf-8", "ignore"), len(w[3].decode("utf-8", "ignore"))) for (d, _), w in zip(rows_of(docs), texts)), key=repr)
    clean = names[3](spark, docs, folder)
    hits = hit_words([t for _, t in rows_of(docs)], ITEMS)
    assert sorted(map(repr, rows_of(clean))) == sorted(repr(r) for r, (n, h, _) in zip(rows_of(docs), hits) if not (h and 20 * h >= n))
    coded = names[4](spark, docs, folder).collect()
    library = Tokenizer.from_file(P.public_tokenizers.path(WORD_VOCABULARY))
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in coded))) == sorted(map(repr, ((d, library.encode(t or "", add_special_tokens=False).ids) for d, t in rows_of(docs))))


def test_run(spark, folder):
    got = P.run(spark, folder).collect()
    ids = [r.doc_id for r in got]
    assert not set(ids) & {200, 201, *range(300, 320)} and 400 in ids
