"""The registered queries: against DuckDB where SQL expresses them, else against plain Python, over whole tables."""

import re

import pytest

import __spark_entry__ as entry
from slotwise.llm import oracles, queries
from tests.llm import brute
from tools.compare import compare, duck


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_oracle(spark, con, small_dir, name):
    got = queries.QUERIES[name](spark, small_dir).toArrow()
    assert got.num_rows
    assert compare(got, con.sql(oracles.ORACLES[name]).to_arrow_table()) is None


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.fixture(scope="module")
def texts(spark, small_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}


def test_byte_bpe_equals_tiktoken(spark, small_dir, texts):
    import base64

    import tiktoken

    path, pattern = queries.tokenizer_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op4_byte_bpe(spark, small_dir).collect():
        ids = plain.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(texts[r.doc_id] or ""))


def test_jaccard_equals_brute_force(spark, small_dir, texts):
    want = brute.jaccard_components(texts.items())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard(spark, small_dir).collect()} == want


def test_quality_counts_equal_brute_force(spark, small_dir, texts):
    for r in queries.op9_quality_rules(spark, small_dir).collect():
        want = brute.quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_scores_separate_labelled_documents(spark, small_dir):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    rows = queries.op9_quality_rules(spark, small_dir).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r.score for r in rows if r.quality == 1]
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.97 * len(good)
    assert sum(good) / len(good) > sum(r.score for r in rows if r.quality == 0) / max(1, sum(r.quality == 0 for r in rows))


def test_language_id_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op8_language_id(spark, folder).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op7_toxicity(spark, folder).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in rows)
