import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessaline.llm import bpe

from .helpers import AWKWARD, awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_encode_decode_as_the_library(spark, library):
    rows = bpe.digests(bpe.decode(bpe.encode(awkward(spark), PATH), PATH)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    want = []
    for doc_id, text, *_ in AWKWARD:
        ids, decoded = expected(library, text)
        want.append((doc_id is None, doc_id or 0, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)
    together = bpe.digests(bpe.encode(awkward(spark), PATH, decoded=True)).collect()
    assert sorted(map(tuple, together), key=str) == sorted(map(tuple, rows), key=str)


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).count() == 0


def test_several_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 64)
    docs = spark.createDataFrame([(i, f"some text number {i} and more of it") for i in range(40)], "doc_id long, text string").coalesce(2)
    for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect():
        ids, decoded = expected(library, f"some text number {r['doc_id']} and more of it")
        assert list(struct.unpack(f"<{r['n_tokens']}I", r["ids"])) == ids and r["decoded"] == decoded


_alphabet = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aàA 'stré\n\t\x1c\x1d\x85\xa0 ‐ İΣſ1½²'<|>é"))
_word_bpe = []


@settings(max_examples=400, deadline=None)
@given(st.text(_alphabet, max_size=40))
def test_words_as_the_library(text):
    if not _word_bpe:
        _word_bpe.append(bpe.WordBpe(open(PATH, encoding="utf-8").read()))
    own = _word_bpe[0]
    ids = [i for w in own.words(text) for i in own.encode_word(w)]
    assert ids == own.tokenizer.encode(text, add_special_tokens=False).ids
