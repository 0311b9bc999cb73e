"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that never stand side by side inside any vocabulary token
can never be merged, so a cut between them is certain.  A pre-token is cut at all
such places, the fragments are encoded independently and concatenated.  Only a
pre-token's last fragment carries the word-end suffix."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import give_back, model_bytes, texts_of, with_arrow

#: Pre-tokens a worker remembers; then it starts anew.
CACHE_ENTRIES = 300_000
#: Bytes of text, or of ids, that a worker handles at a time: the strings of pre-tokens
#: take many times the bytes they are cut from.
SLICE = 250_000
#: Texts with none of these need no library call for normal form and classes (a test tries all code points).
_UNUSUAL = regex.compile("[^\\x00-ɏ‐-⁄]")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class ForcedBoundaryBpe:
    """A word-level BPE vocabulary (lower case, word-end suffix) from its JSON file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        # only its normal form is asked of the library, so it holds no third copy of the vocabulary
        bare = spec | {"model": model | {"vocab": {}, "merges": [], "unk_token": None}, "added_tokens": [], "post_processor": None}
        self.normalizer = Tokenizer.from_str(json.dumps(bare)).normalizer
        letters = byte_letters()
        self.letters = {i: c for i, c in enumerate(letters)}
        self.joined = self.seen_pairs(model["vocab"], {c: i for i, c in enumerate(letters)})
        specials = spec["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in specials):
            raise ValueError("special tokens must be plain strings")
        self.special = {t["content"]: t["id"] for t in specials}
        self.special_at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if specials else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.cache: dict[str, bytes] = {}

    def seen_pairs(self, vocab: dict[str, int], byte_of: dict[str, int]) -> np.ndarray:
        """[a, b]: whether byte a is followed by byte b inside some token."""
        seen = np.zeros((256, 256), bool)
        for token in vocab:
            body = token.removesuffix(self.suffix) if self.suffix and token != self.suffix else token
            codes = [byte_of[c] for c in body if c in byte_of]
            seen[codes[:-1], codes[1:]] = True
        return seen

    def cuts(self, words: list[bytes]) -> dict[int, list[int]]:
        """Certain cuts inside each word, by its place in the list; words of one
        fragment are not listed."""
        codes = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        cut = np.flatnonzero(~self.joined[codes[:-1], codes[1:]]) + 1
        word = np.searchsorted(ends, cut, side="right")
        place = cut - (ends - sizes)[word]
        found: dict[int, list[int]] = {}
        for w, c in zip(word[place > 0].tolist(), place[place > 0].tolist()):
            found.setdefault(w, []).append(c)
        return found

    def ids_of(self, model, fragment: bytes) -> list[int]:
        letters = fragment.decode("latin-1").translate(self.letters)
        return [t.id for t in model.tokenize(letters)]

    def learn(self, needed: set[str]) -> None:
        """Encode the needed pre-tokens that are not known yet."""
        words = [w for w in needed if w not in self.cache]
        if len(self.cache) + len(words) > CACHE_ENTRIES:
            self.cache.clear()
            words = list(needed)
        if not words:
            return
        raw = [w.encode() for w in words]
        cuts = self.cuts(raw)
        for at, (word, data) in enumerate(zip(words, raw)):
            if at not in cuts:
                ids = self.ids_of(self.last, data)
            else:
                edges, ids = [0, *cuts[at]], []
                for a, b in zip(edges, edges[1:]):
                    ids += self.ids_of(self.inner, data[a:b])
                ids += self.ids_of(self.last, data[edges[-1]:])
            self.cache[word] = array("i", ids).tobytes()

    def pre_tokens(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.words.findall(text.lower())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        parts = [[p if p in self.special else self.pre_tokens(p) for p in (self.special_at.split(t) if self.special_at else [t])] for t in texts]
        self.learn(set().union(*(p for text in parts for p in text if not isinstance(p, str))))
        cache = self.cache
        return [b"".join([array("i", [self.special[p]]).tobytes() if isinstance(p, str) else b"".join([cache[w] for w in p]) for p in text]) for text in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()


def token_names(data: bytes) -> dict[int, str]:
    """The string of each id; special tokens included."""
    spec = json.loads(data)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def decode(names: dict[int, str], ids) -> str:
    """Token strings with a space between, as a vocabulary without a decoder is
    decoded; ids outside the vocabulary are left out."""
    return " ".join([names[i] for i in ids if i in names])


@lru_cache(maxsize=2)
def _names(data: bytes) -> dict[int, str]:
    return token_names(data)


@lru_cache(maxsize=2)
def _codec(data: bytes) -> ForcedBoundaryBpe:
    codec = ForcedBoundaryBpe(data.decode())
    give_back()  # what the parsed file took
    return codec


def id_lists(codec: ForcedBoundaryBpe, column: pa.Array) -> pa.Array:
    """The ids of each text of a column; a null text has none."""
    found = codec.encode_all(texts_of(column))
    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def decoded_lists(names: dict[int, str], column: pa.Array) -> pa.Array:
    """The text of each id array of a column; a null array gives an empty text."""
    ends = np.concatenate([[0], np.cumsum(np.array(column.value_lengths().fill_null(0)))])
    flat = column.flatten().to_pylist()
    return pa.array([decode(names, flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())


def encode_texts(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` plus the token ids of each whole text (array<int>).

    A null or empty text has an empty array; repeated rows stay; a column named
    `out` is replaced.  Row-local: no shuffle at any size."""
    data = model_bytes(df.sparkSession, vocabulary_path)

    def make():
        codec = _codec(data.value)
        return lambda column: [id_lists(codec, column)]

    return with_arrow(df, [text], {out: "array<int>"}, make, slice_bytes=SLICE)


def decode_ids(df: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` plus the text of each id array; a null array gives an empty text."""
    data = model_bytes(df.sparkSession, vocabulary_path)

    def make():
        names = _names(data.value)
        return lambda column: [decoded_lists(names, column)]

    return with_arrow(df, [ids], {out: "string"}, make, slice_bytes=SLICE)


def encode_and_decode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the ids of each whole text and what they decode to instead of the
    text: :func:`decode_ids` of :func:`encode_texts`, in one Python worker a task
    instead of two that hold their tables side by side."""
    data = model_bytes(df.sparkSession, vocabulary_path)

    def make():
        codec, names = _codec(data.value), _names(data.value)

        def both(column):
            coded = id_lists(codec, column)
            return [coded, decoded_lists(names, coded)]

        return both

    return with_arrow(df, [text], {ids: "array<int>", decoded: "string"}, make, drop=(text,), slice_bytes=SLICE)
