import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm import bpe
from slotwise.llm.queries import tokenizer_file
from tests.llm import brute


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(tokenizer_file()[0])


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Encoder(bpe.PerfectHash(ranks), tokenizer_file()[1])


@pytest.fixture(scope="module")
def plain():
    path, pattern = tokenizer_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_rejects_others(ranks):
    table = bpe.PerfectHash(ranks)
    assert len(table.key) == len(ranks) and None not in table.key
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"no such token at all") == -1 and bpe.PerfectHash({}).get(b"x") == -1


def test_pattern_is_the_known_one():
    assert tokenizer_file()[1] == bpe.KNOWN_PATTERN


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab Z12\n\t'’sé漢🙂²½\x85\xa0‍ßŁ_-!Ωж\x1c\r") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_equals_tiktoken(coder, plain, text):
    ids = coder.encode(text)
    assert ids == plain.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_long_pieces_and_stretches(coder, plain, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef") for _ in range(5000)), " ".join("word" + str(i) for i in range(3000)), "\n" * 999, "é" * 400]
    monkeypatch.setattr(bpe, "STRETCH", 100)
    for text in texts:
        assert coder.encode(text) == plain.encode_ordinary(text)


def test_memo_rotation_keeps_results(ranks, plain, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 7)
    monkeypatch.setattr(bpe, "PAIRS", 11)
    small = bpe.Encoder(bpe.PerfectHash(ranks), tokenizer_file()[1])
    text = " ".join(f"unusual{i} the of zyx{i % 5}" for i in range(200))
    assert small.encode(text) == plain.encode_ordinary(text)


def test_rows(spark, repeated, empty, plain):
    path, pattern = tokenizer_file()
    want = sorted((r.doc_id, brute.sha(" ".join(map(str, plain.encode_ordinary(r.text or "")))), brute.sha(r.text or ""))
                  for r in repeated.collect() if r.doc_id is not None)
    got = bpe.round_trip(repeated, path, pattern).collect()
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id is not None) == want
    coded = bpe.encode(repeated, path, pattern)
    assert {"lang", "source", "ids", "n_tokens", "key"} <= set(coded.columns) and "text" not in coded.columns
    assert all(list(r.ids) == plain.encode_ordinary(r.text or "") for r in coded.join(repeated.select("doc_id", "text").distinct(), "doc_id").collect())
    assert bpe.round_trip(empty, path, pattern).count() == 0 and bpe.encode(empty, path, pattern).count() == 0
