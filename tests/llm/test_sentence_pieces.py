"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loadaudit.llm import queries, sentence_pieces
from sentencepiece import SentencePieceProcessor

SF = "/root/testdata/sf0.001"
PATH = sentence_pieces.vocabulary_path(sentence_pieces.VOCABULARY)
LIBRARY = SentencePieceProcessor(model_file=PATH)
CODE = sentence_pieces.Pieces(PATH)


def same(items):
    ids, at = sentence_pieces.with_ends(*CODE.encode(items), 1, 2)
    want = LIBRARY.encode(items, add_bos=True, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert CODE.decode(ids, at) == LIBRARY.decode(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_any_text(items):
    same(items)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aeint hrs \n", max_size=300), min_size=1, max_size=3))
def test_texts_of_few_letters(items):
    same(items)


def test_pieces_in_any_order():
    r = random.Random(7)
    names = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(CODE.n)]
    for _ in range(60):
        same(["".join(r.choice(names) for _ in range(r.randrange(40))) for _ in range(20)])


@pytest.mark.parametrize("text", ["", " ", " " * 200, "a" * 3000, "ab" * 2000, "\x00", "▁▁ ▁", "<s></s><unk><0x0A>", "é 日本 🙂", "\n" * 500, "x " * 4000])
def test_odd_texts(text):
    same([text])


def test_a_segment_runs_in_rounds_as_by_its_heap():
    r = random.Random(9)
    words = ["▁" + "".join(r.choice("etaoinshr") for _ in range(r.randrange(1, 40))) for _ in range(300)]
    codes = np.concatenate([CODE.symbol[[ord(c) for c in w]] for w in words])
    start = np.cumsum([0] + [len(w) for w in words[:-1]])
    final, count = CODE._rounds(codes.copy(), start)
    for w, part in zip(words, np.split(final, np.cumsum(count)[:-1]), strict=True):
        assert CODE._heap(CODE.symbol[[ord(c) for c in w]].tolist())[0] == part.tolist()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBER", 5)
    same(["one two three", "two three four five six seven", "eight nine", ""])


def test_decoding_of_any_ids():
    r = random.Random(11)
    rows = [[r.randrange(CODE.n) if r.random() < 0.7 else r.randrange(300) for _ in range(r.randrange(12))] for _ in range(500)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    ids = np.array([i for x in rows for i in x], np.uint32)
    assert CODE.decode(ids, at) == LIBRARY.decode(rows)


def test_a_difference_is_an_error():
    ids, at = sentence_pieces.with_ends(*CODE.encode(["one two"]), 1, 2)
    with pytest.raises(ValueError, match="ids"):
        sentence_pieces._compare(CODE, ["one twp"], ids, at, ["one two"])
    with pytest.raises(ValueError, match="decoded"):
        sentence_pieces._compare(CODE, ["one two"], ids, at, ["one"])


def test_odd_tables(odd, none):
    rows = sentence_pieces.encode(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_tokens * 4 == len(r.ids)
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert [(r.n_tokens, r.decoded) for r in empty] == [(2, "")] * 2
    assert sorted(r.decoded for r in rows) == sorted(r.text or "" for r in odd.select("text").collect())
    assert sentence_pieces.encode(none).collect() == []


def test_stored_ids_decode_again(spark, odd):
    coded = sentence_pieces.encode(odd, check=False)
    back = sentence_pieces.decode(coded)
    assert sorted(map(str, back.collect())) == sorted(str(r) for r in coded.selectExpr("doc_id", "decoded AS text").collect())
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id bigint, ids binary")
    assert [r.text for r in sentence_pieces.decode(rows).collect()] == ["", ""]


def test_query(spark):
    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.QUERIES["op13_sentence_pieces"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
