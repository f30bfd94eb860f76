"""Encoding and decoding against the library, part by part and on whole tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from corpus import DOCS, docs, prose, rows  # noqa: F401

from flowhelm.llm import pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a▁b", "\n", "a \n b", "\x00a", "﻿x", "</s>", "<0x0A>", "\t\tq", "é́", "ﬁ", " " * 77 + "x" + " " * 33, "▁" * 50, "�", "😀 😀a", "a" * 200, "\r\n\r\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


def words(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_encodes_like_the_library(library, vocabulary):
    encoder, rng = pieces.Encoder(vocabulary), random.Random(1)
    signs = [*" " * 6, *"etaoinshrdlu" * 3, *"ABXYZ0123456789.,;:!?-_()[]{}<>/\\'\"\n\té漢字日本語한국어üñßжшли😀▁​"]
    known = [p for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if k == pieces.NORMAL]
    texts = [*ODD, *("".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(4000))]
    texts += ["".join(rng.choice(known) for _ in range(rng.randint(1, 8))).replace("▁", " ") for _ in range(4000)]
    for text in texts:
        assert encoder.encode(text) == words(library.encode(text, add_bos=True, add_eos=True)), text
        assert encoder.encode(text, begin=False, end=False) == words(library.encode(text))


def test_decodes_like_the_library(library, vocabulary):
    decoder, rng = pieces.Decoder(vocabulary), random.Random(2)
    for _ in range(8000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(262) for _ in range(rng.randint(0, 8))]
        assert decoder.decode(words(ids)) == library.decode(ids), ids
    assert decoder.decode(None) == "" and decoder.decode(words([10**6])) == "�"


def test_parts_and_stores_of_any_size(library, vocabulary, monkeypatch):
    text = prose(random.Random(3), 400) + "\n" + "abcdefgh" * 300
    want = words(library.encode(text, add_bos=True, add_eos=True))
    for size, store in ((7, 5), (64, 1), (1 << 20, 1000)):
        monkeypatch.setattr(pieces, "PART_CHARS", size)
        monkeypatch.setattr(pieces, "STORE_PARTS", store)
        encoder = pieces.Encoder(vocabulary)
        assert encoder.encode(text) == want and encoder.encode(text) == want and len(encoder) <= store


def test_long_text_without_a_cut(library, vocabulary):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(200_000))
    assert pieces.Encoder(vocabulary).encode(text) == words(library.encode(text, add_bos=True, add_eos=True))


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as file:
        data = file.read()
    (tmp_path / "other.model").write_bytes(data + bytes([0x1A, 2, 0x20, 1]))  # a normaliser that removes spaces
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(tmp_path / "other.model"))


def test_tables(spark, docs, rows, library):
    frame = docs.withColumnsRenamed({"lang": "ids", "source": "decoded"})  # names of the new columns: replaced
    got = pieces.decode(pieces.encode(frame, MODEL), MODEL)
    assert sorted(got.columns) == sorted(["doc_id", "text", "n_chars", "ids", "decoded"])
    found = {r.doc_id: r for r in got.collect()}
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert bytes(found[i].ids) == words(ids) and found[i].decoded == library.decode(ids) and found[i].text == text
    lists = pieces.encode(docs, MODEL, as_array=True)
    assert {r.doc_id: r.ids for r in lists.collect()} == {i: library.encode(t or "", add_bos=True, add_eos=True) for i, t, *_ in rows}
    assert {r.doc_id: r.decoded for r in pieces.decode(lists, MODEL).collect()} == {i: r.decoded for i, r in found.items()}
    empty = spark.createDataFrame([], DOCS)
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0
    twice = pieces.encode(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string"), MODEL, as_array=True)
    assert sorted((r.doc_id or 0, r.ids) for r in twice.collect()) == [(0, [1, 264, 287, 2]), (0, [1, 264, 287, 2]), (1, [1, 2])]


def test_query(spark, sf, library):
    got = {r.doc_id: r for r in queries.QUERIES["op12_pieces"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(words(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
