"""Every stage of the pipeline against plain Python on the stage's own input."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import langid, mixing
from slotwise.llm.common import documents, held_out
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small_dir, tmp_path_factory):
    """Input and output of each stage, written and read between stages as the pipeline does."""
    rows, out = documents(spark, small_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, rows, small_dir).write.parquet(path)
        out[name] = (rows, spark.read.parquet(path))
        rows = out[name][1]
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "byte_bpe"]
    assert all(stages[n][1].columns == COLUMNS for n in ("language_id", "line_dedup", "ngram_jaccard", "mixing"))


def test_language_id_stage(stages):
    before, after = stages["language_id"]
    judged = {r.doc_id: r.lang_pred for r in langid.identify(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, lang in judged.items() if lang != "und")


def test_language_found_reaches_the_result(spark, tmp_path):
    """Rows without a language, or with a wrong one that is held out, carry the language of their text to the end."""
    words = {"en": "the house of my old friend and his garden", "de": "der garten von einem alten freund und sein haus"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=60)) + f" {lang}{i}", lang, "a", 9) for i, lang in enumerate(["en", "de"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = F.when(F.col("doc_id") < 10, None).when(held_out(F.col("doc_id")), "fr").otherwise(F.col("lang"))
    docs.withColumn("lang", odd).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.lang for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {r[0]: r[2] for r in rows if r[0] in found} and set(range(10)) & set(found)


def test_line_dedup_stage(stages):
    before, after = stages["line_dedup"]
    want = brute.dedupe_lines(texts(before))
    rows = after.collect()
    assert {r.doc_id: r.text for r in rows} == {i: kept for i, (_, _, kept) in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_jaccard_stage(stages):
    before, after = stages["ngram_jaccard"]
    want = brute.jaccard_components(texts(before))
    assert sorted(i for i, _ in texts(after)) == sorted({c for _, c in want.values()})


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    assert collections.Counter(i for i, _ in texts(after)) == +collections.Counter(copies)


def test_bpe_stage_and_run(spark, stages, small_dir):
    from slotwise.llm.bpe import Encoder, PerfectHash, read_ranks

    before, after = stages["byte_bpe"]
    path, pattern = corpus_pipeline.tokenizer_file()
    coder = Encoder(PerfectHash(read_ranks(path)), pattern)
    want = sorted((i, coder.encode(t)) for i, t in texts(before))
    assert sorted((r.doc_id, list(r.ids)) for r in after.collect()) == want
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "ids").cast("decimal(38,0)"))).first()
    assert digest(corpus_pipeline.run(spark, small_dir)) == digest(after)


@pytest.mark.parametrize("table", ["repeated", "empty"])
def test_run_over_nulls_repeats_clashing_columns_and_no_rows(spark, request, tmp_path, table):
    docs = request.getfixturevalue(table)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows, kept = documents(spark, str(tmp_path)), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == docs.columns
        rows = corpus_pipeline.store(out, f"test-{name}")
        kept.append(rows.count())
    assert kept[1] == kept[0] and kept[2] <= kept[1] and (table == "empty") == (kept[0] == 0)
    if table == "repeated":
        left = {r.doc_id for r in rows.collect()}
        assert not left & {5, 6, 7, 16} and not {1, 2} <= left
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() == kept[3] and result.columns == ["doc_id", "lang", "source", "ids", "n_tokens"]
