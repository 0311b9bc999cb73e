"""Token counts and the codec against their libraries."""

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from notewarden.llm import bpe, token_counts
from notewarden.llm.queries import PIECE_MODEL, WORD_VOCABULARY

from .helpers import corpus

ODD = ["", " ", "  a  b ", "\n\na \n b", "▁x ▁▁y", "é漢字 🙂🙂 ﬁ Σας ΟΔΟΣ", "\x00\x1c\x85 ​ x́É", "<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>it's I'LL 12 x²½", "a" * 3000, "ÀÉ" * 500, "İ K ǅ ẞ", "\n", "x\n", "\t\r\n a", "<s>a</s> <0x0A>"]
POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(WORD_VOCABULARY))


def test_counter_equals_library(sp):
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as f:
        counter = token_counts.PieceCounter(f.read())
    assert len(counter.whole) > 10_000 and counter.marks_lead
    texts = ODD + [f"a{c}b {c}\n{c}" for c in POINTS[::7]]
    assert counter.count_all(texts) == [len(x) for x in sp.encode(texts, num_threads=4)]


def test_counter_forgets(sp, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 10)
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as f:
        counter = token_counts.PieceCounter(f.read())
    assert [counter.count_all([t])[0] for t in ODD] == [len(sp.encode(t)) for t in ODD]


def test_count_tokens(docs_of, sp):
    rows = corpus()
    got = token_counts.count_tokens(docs_of(rows), public_tokenizers.path(PIECE_MODEL)).collect()
    assert sorted(((r.doc_id, r.text, r.n_tokens) for r in got), key=repr) == sorted(((d, t, len(sp.encode(t or ""))) for d, t in rows), key=repr)


def test_clashing_column_is_replaced(spark):
    df = spark.createDataFrame([("a b", "x", None)], "text string, N_Tokens string, key string")
    out = token_counts.count_tokens(df, public_tokenizers.path(PIECE_MODEL))
    assert out.columns == ["text", "key", "n_tokens"] and out.first()["n_tokens"] == 2
    assert token_counts.count_tokens(df.limit(0), public_tokenizers.path(PIECE_MODEL)).collect() == []


def test_codec_equals_library(library):
    with open(public_tokenizers.path(WORD_VOCABULARY), "rb") as f:
        data = f.read()
    codec, names = bpe.ForcedBoundaryBpe(data.decode()), bpe.token_names(data)
    assert not codec.joined.all()
    texts = ODD + [f"a{c}b {c}1{c}" for c in POINTS[::5]]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [codec.encode(t) for t in texts]
    assert got == want
    assert [bpe.decode(names, x) for x in got] == library.decode_batch(want, skip_special_tokens=False)


def test_encode_decode(spark, docs_of, library):
    path = public_tokenizers.path(WORD_VOCABULARY)
    rows = corpus()
    got = bpe.decode_ids(bpe.encode_texts(docs_of(rows), path), path).collect()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert len(got) == len(rows)
    assert bpe.decode_ids(spark.createDataFrame([(None,), ([],)], "ids array<int>"), path).collect()[0]["decoded"] == ""


def python_maps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_round_trip_in_one_worker(docs_of, library):
    path = public_tokenizers.path(WORD_VOCABULARY)
    rows = corpus()
    coded = bpe.encode_and_decode(docs_of(rows), path)
    assert python_maps(coded) == 1 and coded.columns == ["doc_id", "ids", "decoded"]
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = [(d, x, library.decode(x, skip_special_tokens=False)) for (d, _), x in zip(rows, ids)]
    assert sorted(map(repr, ((r.doc_id, r.ids, r.decoded) for r in coded.collect()))) == sorted(map(repr, want))


def test_stages_hold_one_worker_a_task(spark, docs_of):
    import corpus_pipeline

    docs = docs_of(corpus()).selectExpr("doc_id", "'en' AS lang", "'s' AS source", "text")
    assert python_maps(corpus_pipeline.tokens(spark, docs, "")) == 1


def test_codec_handles_small_slices(library):
    """A batch of many texts holds the pre-tokens of a small part at a time."""
    assert bpe.SLICE <= 250_000
    with open(public_tokenizers.path(WORD_VOCABULARY), "rb") as f:
        codec = bpe.ForcedBoundaryBpe(f.read().decode())
    assert not hasattr(codec, "library") and not hasattr(codec, "vocab")  # no further copies of the vocabulary
    assert codec.normalizer.normalize_str("ÀÉ ﬁ  x") == library.normalizer.normalize_str("ÀÉ ﬁ  x")
