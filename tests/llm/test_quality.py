"""The threshold of the quality rules on labelled rows, and exact counts of repeated words."""

import random

from pyspark.sql import functions as F

from slotwise.llm import quality
from slotwise.llm.common import held_out
from tests.llm import brute


def test_cut_lies_between_the_classes():
    assert quality.cut([(-0.1, 1), (-0.2, 1), (-0.6, 0), (-0.9, 0)]) == -0.4
    assert quality.cut([(-0.2, 1)] * 100 + [(-0.9, 1), (-0.95, 1), (-0.3, 0)]) == -0.25  # 2 of 102 good ones go
    assert quality.cut([(-0.2, 1)] * 10 + [(-0.9, 1), (-0.3, 0), (-1.0, 0)]) == -0.95  # 1 of 11 good ones would be too many
    assert quality.cut([(-0.2, 1)]) == quality.cut([(-0.2, 0)]) == quality.cut([]) == float("-inf")


def test_threshold_documents_are_neither_target_nor_held_out(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    target = {r[0] for r in quality.target_ids(labels, labels).collect()}
    chosen = {r[0]: r[1] for r in quality.threshold_ids(labels).collect()}
    tested = {r[0] for r in labels.filter(held_out(F.col("doc_id"))).collect()}
    assert not target & set(chosen) and not tested & (target | set(chosen))
    assert all(good == i % 2 for i, good in chosen.items()) and target | set(chosen) | tested == {*range(200), None}


def test_held_out_junk_is_rejected(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").repartition(16)
    rows = quality.judge(docs, labels).join(labels, "doc_id").select("doc_id", "quality", "base_failed", "kept", held_out(F.col("doc_id")).alias("test")).collect()
    rows = [r for r in rows if r.test and not r.base_failed]
    junk, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert len(junk) > 50 and sum(r.kept for r in junk) <= 0.02 * len(junk)
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_windows_that_agree_in_part_of_the_hash_are_no_repeats(spark):
    """The lower 46 bits of the hashes of "a b 2132697" and "a b 11425335" are the same, all that is left at 2^17 words."""
    same = spark.sql("SELECT shiftleft(xxhash64('a', 'b', '2132697'), 18) = shiftleft(xxhash64('a', 'b', '11425335'), 18)").first()[0]
    filler = " ".join(f"w{i}" for i in range(1 << 17))
    texts = [f"a b 2132697 {filler} a b 11425335", f"a b 2132697 {filler} a b 11425335 x a b 2132697"]
    rows = quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert same and [r.n_repeat_words for r in rows] == [brute.quality_counts(t)[4] for t in texts] == [0, 6]


def test_no_document_is_left_out_of_target_or_threshold(spark):
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 4 > 0 AS INT) AS quality", "0 AS toxic")
    train = {r[0]: r[1] for r in labels.filter(~held_out(F.col("doc_id"))).collect()}
    apart = {r[0] for r in labels.filter(quality._apart(F.col("doc_id"))).collect()}
    target = {r[0] for r in quality.target_ids(labels, labels).collect()}
    chosen = {r[0]: r[1] for r in quality.threshold_ids(labels).collect()}
    assert target == {i for i, good in train.items() if good and i not in apart} and len(target) > 4000
    assert chosen == {i: good for i, good in train.items() if not good or i in apart} and sum(not g for g in chosen.values()) > 4000


def test_cut_in_many_tasks_equals_the_plain_one(spark):
    rng = random.Random(3)
    lists = [[(-0.1, 1), (-0.2, 1), (-0.6, 0), (-0.9, 0)], [(-0.2, 1)] * 100 + [(-0.9, 1), (-0.95, 1), (-0.3, 0)],
             [(-0.2, 1)] * 10 + [(-0.9, 1), (-0.3, 0), (-1.0, 0)], [(-0.2, 1)], [(-0.2, 0)], [], [(0.0, 1), (0.0, 0)], [(0.5, 0), (-0.5, 1)]]
    lists += [[(round(rng.gauss(good * width, 1), digits), good) for good in (rng.randint(0, 1) for _ in range(400))] for width, digits in ((1, 1), (4, 2), (6, 6))]
    for scores in lists:
        assert quality.best_cut(spark.createDataFrame(scores, "score double, good long")) == quality.cut(scores)
