import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketveil.llm import bpe

from .helpers import empty_docs, odd_docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    ranks = bpe.read_ranks(PATH)
    return bpe.Tokenizer(ranks, bpe.model_bytes(ranks), P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["a", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "'s", "'", "1", "²", "é", "́", "漢", "😀", ".", "-", "The", " the", "▁", "<unk>", "\x00"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.text(max_size=40)))
def test_same_ids_and_round_trip(ours, theirs, text):
    text = text.encode("utf-8", "replace").decode()
    ids = np.frombuffer(ours.encode(text), "<u4")
    assert ids.tolist() == theirs.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_tables(spark, theirs):
    for r in bpe.round_trip(odd_docs(spark), PATH, P.PATTERN, keep_ids=True).collect():
        text = next(x.text for x in odd_docs(spark).collect() if x.doc_id == r.doc_id) or ""
        ids = theirs.encode_ordinary(text)
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(empty_docs(spark), PATH, P.PATTERN).count() == 0


def test_encode_then_decode(spark):
    encoded = bpe.encode(odd_docs(spark), PATH, P.PATTERN, ids="ids")
    out = bpe.decode(encoded, PATH)
    assert out.columns[-1] == "decoded"
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out.collect())


def test_memory_is_bounded_by_bytes(monkeypatch):
    ranks = bpe.read_ranks(PATH)
    monkeypatch.setattr(bpe, "MEMORY", 20_000)
    own, fresh = (bpe.Tokenizer(ranks, bpe.model_bytes(ranks), P.PATTERN) for _ in range(2))
    for i in range(400):
        text = f"word{i} " + "x" * (i * 7) + f" {i}"
        assert own.encode(text) == fresh.encode(text)
        fresh.known.clear()
        assert sum(len(s) + len(b) for s, b in own.known.items()) <= own.held <= 20_000 + 3000
        assert max(map(len, own.known)) <= bpe.LONGEST
