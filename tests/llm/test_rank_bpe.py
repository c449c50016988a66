"""Encoding by ranks against the tiktoken library on whole texts, and the raw-byte round trip."""
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revtrace.llm import q_rank_bpe, rank_bpe

from .edge import frame, texts


@pytest.fixture(scope="module")
def enc():
    return rank_bpe.encoder(*q_rank_bpe.vocabulary())


def same(enc, text, limit):
    found = [i for p, whole in rank_bpe.safe_pieces(text, limit) for i in (enc.one_match if whole else enc.by_pattern).encode_ordinary(p)]
    assert found == enc.by_pattern.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's'll1٣漢。,!\n\t\x1c\x85　​é—😀"), max_size=60), st.integers(1, 9))
def test_cuts_keep_the_ids(enc, text, limit):
    same(enc, text, limit)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(1, 20))
def test_cuts_keep_the_ids_of_any_text(enc, text, limit):
    same(enc, text, limit)


@pytest.mark.parametrize("end", ["", "x", "1", "!", "'s", "\n"])
@pytest.mark.parametrize("run", [" " * 40000, "\n \t" * 20000, " " * 39999 + "\n"])
def test_long_white_space(enc, run, end):
    text = "it's so" + run + end
    assert enc.encode(text) == enc.by_pattern.encode_ordinary(text)
    assert enc.decode(enc.encode(text)) == text.encode()


def test_texts_beyond_the_librarys_stack(enc):
    for text in [" " * 1_500_000 + "x", "x" * 300_000, "ab" * 100_000 + " " * 1_200_000]:
        assert enc.decode(enc.encode(text)) == text.encode()
    long_ = "some words, 12 numbers; it's long. " * 20_000
    assert len(list(rank_bpe.safe_pieces(long_))) > 5 and enc.encode(long_) == enc.by_pattern.encode_ordinary(long_)


def test_parts_decode_to_raw_bytes(enc):
    ids = enc.encode("漢字 😀 é")
    assert b"".join(enc.decode([i]) for i in ids) == "漢字 😀 é".encode()


def test_table(spark, enc):
    docs = frame(spark)
    lib = enc.by_pattern
    want = []
    for d, t in texts():
        ids = lib.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in rank_bpe.encoding_digests(docs, *q_rank_bpe.vocabulary()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    encoded = rank_bpe.encode_documents(docs, *q_rank_bpe.vocabulary())
    back = rank_bpe.decode_documents(encoded, *q_rank_bpe.vocabulary()).collect()
    assert sorted(((r.doc_id, bytes(r.data)) for r in back), key=str) == sorted(((d, (t or "").encode()) for d, t in texts()), key=str)
    assert rank_bpe.encoding_digests(docs.limit(0), *q_rank_bpe.vocabulary()).count() == 0
