import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slotwise.llm import packing, queries
from tests.llm.conftest import DOCS

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer, max_length=4096):
    """Every id in one piece, in place; lengths are powers of two; each sequence one piece, numbered without gaps by bucket."""
    want = collections.Counter()
    for doc, text in texts:
        want[doc, np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()] += 1
    held = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.sequence_id):
        held[r.doc_id, r.doc_tokens].append(r)
        assert r.length & (r.length - 1) == 0 and 1 <= r.length <= max_length and r.offset == 0
    numbers = sorted((r.sequence_id, r.length) for r in rows)
    assert [n for n, _ in numbers] == list(range(len(rows)))
    assert [k for _, k in numbers] == sorted((k for _, k in numbers), reverse=True)
    once = {key: n for key, n in want.items()}
    for (doc, ids), times in once.items():
        pieces = collections.Counter((r.start, r.length, bytes(r.ids)) for r in held[doc, len(ids) // 4])
        at = 0
        for length in packing.piece_lengths(len(ids) // 4, max_length):
            assert pieces[at, length, ids[4 * at:4 * (at + length)]] >= times
            at += length
        assert at == len(ids) // 4
    assert len(rows) == sum(n * len(packing.piece_lengths(len(ids) // 4, max_length)) for (_, ids), n in want.items())


def test_piece_lengths_add_up():
    for n in (1, 2, 3, 4095, 4096, 4097, 8191, 123_457):
        found = packing.piece_lengths(n, 4096)
        assert sum(found) == n and found == sorted(found, reverse=True)
        assert all(k & (k - 1) == 0 for k in found) and len({k for k in found if k < 4096}) == len([k for k in found if k < 4096])


def test_word_by_word_equals_whole_text(tokenizer, edge_rows):
    texts = [t or "" for _, t, *_ in edge_rows] + [
        "it's we'll I'm don't 's", "x\x1cy\x85z\xa0w v　u", "İstanbul ΟΔΟΣ é ́a 각", "<|endoftext|> a<|startoftext|>b", "🙂🙂 12ab34 --..--",
        "a1" * 3000 + " tail", "1234567890" * 400, "é" * 3000, "\x00 \x01"]
    coder = packing.WordIds(open(PATH, encoding="utf-8").read())
    for text in texts:
        assert np.frombuffer(coder.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_stretches_and_a_full_memo_change_nothing(tokenizer, monkeypatch):
    text = " ".join(f"word{i % 97} and{i % 89}" for i in range(3000))
    monkeypatch.setattr(packing, "STRETCH", 101)
    monkeypatch.setattr(packing, "MEMO", 20)
    coder = packing.WordIds(open(PATH, encoding="utf-8").read())
    assert np.frombuffer(coder.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("max_length", [4096, 64])
def test_edge_rows(edge, edge_rows, tokenizer, max_length):
    check(packing.pack(edge, PATH, max_length).collect(), [(r[0], r[1]) for r in edge_rows], tokenizer, max_length)


def test_repeats_nulls_and_clashing_columns(repeated, tokenizer):
    rows = [(r.doc_id, r.text) for r in repeated.select("doc_id", "text").collect()]
    check(packing.pack(repeated, PATH).collect(), rows, tokenizer)


def test_empty_table_and_bad_length(empty):
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(empty, PATH, 1000)


def test_buckets_are_folders_of_equal_lengths(spark, edge, tmp_path):
    packed = packing.pack(edge, PATH)
    packing.write_buckets(packed, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.count() == packed.count()
    assert all(len(r.ids) == 4 * r.length for r in back.collect())
    assert {p.name for p in (tmp_path / "buckets").iterdir() if p.is_dir()} == {f"length={r.length}" for r in packed.select("length").distinct().collect()}


def test_query_covers_every_id(spark, small_dir, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    by_doc = collections.defaultdict(list)
    for r in queries.op11_packing(spark, small_dir).collect():
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = np.asarray([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_hot_table_is_numbered_across_tasks(spark, tokenizer):
    rows = [(i % 50, "one two three " * (i % 7), None, None, 0) for i in range(3000)]
    check(packing.pack(spark.createDataFrame(rows, DOCS).repartition(13), PATH).collect(), [(r[0], r[1]) for r in rows], tokenizer)


def test_known_letters_are_cut_as_the_tokenizer_cuts(tokenizer):
    coder, rng = packing.WordIds(open(PATH, encoding="utf-8").read()), random.Random(1)
    assert coder.cut
    words = [w for c in map(chr, range(0x21, 0x250)) for w in (c, f"a{c}b", f"{c}'S{c}", f"1{c}2{c.upper()}") if not packing._BLANK.search(w)]
    letters = [*map(chr, range(0x20, 0x7F)), *map(chr, range(0xA0, 0x250)), "́", "̇", "Σ", "'s", "'LL", "'re", "<|endoftext|>", "½", " "]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for word in words:
        assert np.frombuffer(coder.of(word), "<u4").tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_another_tokenizer_file_is_encoded_word_by_word(tokenizer):
    text = open(PATH, encoding="utf-8").read().replace('"Lowercase"', '"NFD"')
    coder = packing.WordIds(text)
    assert coder.cut is None
    words = "it's a Été of 12 x's"
    assert np.frombuffer(coder.of(words), "<u4").tolist() == Tokenizer.from_str(text).encode(words, add_special_tokens=False).ids


def test_letters_and_closing_marks_need_no_pattern(tokenizer):
    coder = packing.WordIds(open(PATH, encoding="utf-8").read())
    cut, seen = coder.cut, []
    coder.cut = lambda word: seen.append(word) or cut(word)
    texts = ["the Garden, (of) Été: wörter!&&& a.'s", "x_ y's, '' 's' rock'n'roll'... don't! '&' &&& we'll-- 3rd. \x7fa a\x01 İx ſt. ŉ, ſ'S"]
    for text in texts:
        assert np.frombuffer(coder.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not {"the", "garden,", "été:", "wörter!&&&", "x_", "ſt.", "ŉ,"} & {*seen}
    assert {"(of)", "a.'s", "don't!", "3rd."} <= {*seen}
