"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import bpe, chat, jaccard, langid, lexical, linededup, mixing, packing, quality, runs, toxicity, vectors, warc
from slotwise.llm.common import documents, words


def tokenizer_file() -> tuple[str, str]:
    """Path of the public rank file and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(chat.escape_sample(spark))))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return warc.read_bundles(index, folder, payloads=False).drop("payload")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), *tokenizer_file())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedupe_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(documents(spark, sf_dir).select("doc_id", "text"))
    found = lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    index.drop()
    return found


def periodic_texts(docs: DataFrame) -> DataFrame:
    """The contract's documents: with h = crc32(doc_id), those with h % 10 = 0 repeat a stretch of words up to their end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, n, w = F.col("_g"), F.size("_w"), F.col("_w")
    a = (g % n).cast("int")
    period = F.expr("cast(1 + (size(_w) - _a) div (3 + _g % 8) AS int)")
    times = F.expr("cast((size(_w) - _a) div _p + 1 AS int)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, F.col("_a") + 1, F.col("_p")), times)), 1, n - F.col("_a"))
    return (docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words(F.col("text"))).otherwise(F.array()).alias("_w"))
            .withColumn("_a", F.when(n > 0, a).otherwise(0)).withColumn("_p", period)
            .select("doc_id", F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, F.col("_a")), tail), " ")).otherwise(F.col("text")).alias("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(periodic_texts(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best, lines = F.col("best"), F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
                        F.expr("(1000L * best.length) div best.period").alias("exponent_milli"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_warc": op2_warc,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_packing": op11_packing,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
