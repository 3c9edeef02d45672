"""Corpus pipeline: raw documents to token ids, five stages.

1. ``language_id``: documents whose language is undetermined go, ``lang`` becomes the language found in the text;
2. ``line_dedup``: lines that a smaller document holds too go, ``n_chars`` follows;
3. ``ngram_jaccard``: one document of each group of near duplicates stays;
4. ``mixing``: documents are repeated or left out so that sources come near their target weights;
5. ``byte_bpe``: texts become token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import bpe, jaccard, langid, linededup, mixing
from slotwise.llm.common import documents, store
from slotwise.llm.queries import tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language the classifier, learnt from ``docs`` themselves, can name, with that language as their ``lang``.

    The later stages and the result carry the language found, also where ``lang`` was null or named another language.
    Null texts, texts without a letter, and every text if no row has a language are undetermined and go; repeated rows
    stay or go together; an empty table stays empty; further columns are passed through.
    """
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a smaller doc_id holds too.

    A text may become empty (a null one does); rows that share a doc_id are one holder of their lines; a null doc_id is the
    smallest; an empty table stays empty; further columns are passed through.
    """
    kept = linededup.dedupe_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id, for each group of linked texts.

    Texts without words link with nothing and stay, one row per doc_id; wholly equal rows stay once; rows of one doc_id with
    different texts are apart; rows without a doc_id stay; an empty table stays empty; further columns are passed through.
    """
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, three times at most.

    A null source is a source of its own; rows without words are never taken into a source of size 0; ties in size go by doc_id;
    an empty table stays empty; further columns are passed through.
    """
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, ids, n_tokens)`` of every row; a null or empty text has no ids, an empty table no rows; further columns go."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), *tokenizer_file())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("mixing", mix),
          ("byte_bpe", byte_bpe)]

#: The first stage learns a classifier, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for name, stage in STAGES:
        rows = store(stage(spark, rows, sf_dir), f"stage-{name.replace('_', '-')}")
    return rows
