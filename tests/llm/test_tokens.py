"""Token ids, bit packing, shards and pieces: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadaudit.llm import packing, token_files
from loadaudit.llm.tokens import encoder, vocabulary_path


def reference(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_path())
    return [own.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abIT'.,!*#  \n\t\x0b\x1fİ̇̌JΣßé ½²日🙂")), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    ids, at = encoder(vocabulary_path()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == reference(texts)


def test_strings_of_special_tokens_are_these_tokens():
    texts = ["a<|endoftext|>b c", "plain", None, "<|startoftext|> x<|endoftext|>", "A <|ENDOFTEXT|> <|end oftext|>", "", "<|endoftext|>" * 3, "last words."]
    ids, at = encoder(vocabulary_path()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == reference(texts)
    assert 49407 in ids and 49406 in ids


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 20, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpack_bits(data, bits, 1001) == ids).all()


def test_shards_give_back_every_document(spark, odd, none):
    rows = sorted(((r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    manifest = token_files.write_token_files(odd)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    want = sorted((i is not None, i or 0, [*ids, 1]) for (i, _), ids in zip(rows, reference([t for _, t in rows])))
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    starts = np.cumsum([0, *(r.n_tokens for r in got)])
    assert [r.start for r in got] == starts[:-1].tolist()
    first = min(manifest.collect(), key=lambda r: r.shard)
    shard = token_files.Shard(first.path)
    whole = shard.ids(0, shard.n_ids)
    assert shard.bits == 16 and (shard.ids(3, shard.n_ids - 1) == whole[3:-1]).all()
    assert token_files.read_token_files(token_files.write_token_files(none)).count() == 0


def test_pieces_are_powers_of_two_and_hold_every_id_once(odd, none):
    got = packing.pack(odd, limit=64).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length == 1 << r.bucket and r.length <= 64 for r in got)
    want = sorted((i is not None, i or 0, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in ((r.doc_id, reference([r.text])[0]) for r in odd.collect()))
    parts, have = sorted(got, key=lambda r: (r.sequence_id, r.start)), []
    for r in parts:
        if r.start == 0:
            have.append([r.doc_id is not None, r.doc_id or 0, b""])
        assert len(have[-1][2]) == 4 * r.start
        have[-1][2] += bytes(r.ids)
    assert sorted((a, b, zlib.crc32(c)) for a, b, c in have) == want
    assert packing.cuts(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1] and packing.pack(none).count() == 0
