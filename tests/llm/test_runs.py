import random

import numpy as np
import pytest

from slotwise.llm import queries, runs
from tests.llm import brute


def caught(words, exponent=4, length=6, step=None):
    catcher = runs.SquareCatcher(exponent, length)
    for at in range(0, len(words), step or max(1, len(words))):
        catcher.append(np.array(words[at:at + (step or len(words))], np.int64))
    return catcher.runs()


@pytest.mark.parametrize("seed", range(4))
def test_random_words_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(300):
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
        unit = [rng.randrange(3) for _ in range(rng.randint(1, 15))]
        words = words[:20] + (unit * 8)[:rng.randint(0, 90)] + words[20:]
        exponent, length = rng.choice([(2, 1), (3, 4), (4, 6), (4, 6)])
        want = brute.runs(words, exponent, length)
        assert caught(words, exponent, length) == caught(words, exponent, length, 1) == caught(words, exponent, length, rng.randint(2, 19)) == want


def test_each_appended_word_gives_the_runs_so_far():
    rng, catcher, words = random.Random(9), runs.SquareCatcher(), []
    for _ in range(200):
        words.append(rng.choice([0, 0, 0, 1]))
        catcher.append(np.array(words[-1:], np.int64))
        assert catcher.runs() == brute.runs(words)


def test_long_texts_take_seconds():
    for words in ([0] * 400_000, [0] * 200_000 + [1] + [0] * 200_000):
        found = caught(words, step=50_000)
        assert [(n, p) for _, n, p in found] == [(400_000, 1)] * (len(found) == 1) + [(200_000, 1)] * (len(found) == 2) * 2
    unit = list(range(5_000))
    assert caught([7, *unit * 60, 8], step=65_536) == [(1, 300_000, 5_000)]


def test_shorter_than_the_least_length_or_exponent():
    assert caught([1] * 5) == [] and caught([1] * 6) == [(0, 6, 1)]
    assert caught([1, 2, 3] * 3 + [1, 2]) == [] and caught([1, 2, 3] * 4) == [(0, 12, 3)]
    assert caught([1, 2] * 4) == [(0, 8, 2)] and caught([1, 1, 2] * 6 + [1]) == [(0, 19, 3)]
    with pytest.raises(ValueError, match="exponent"):
        runs.SquareCatcher(1)


def check(df, rows):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed))
    for doc, text in rows:
        words = brute.WORD.findall(text or "")
        found = brute.runs(words) if len(words) < 2000 else [tuple(x) for x in got[doc][0][0]]
        dropped = {i for s, n, p in found for i in range(s + p, s + n)}
        best = max(found, key=lambda r: r[1] / r[2], default=None)
        assert (found, best, " ".join(w for i, w in enumerate(words) if i not in dropped)) in got[doc]
    return got


def test_edge_rows_repeats_and_empty_table(edge, repeated, empty, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows] + [(None, None)]
    check(runs.find_runs(edge), rows[:-1])
    found = runs.find_runs(repeated)
    assert found.count() == repeated.count() and "score" in found.columns
    check(found, rows)
    assert runs.find_runs(empty).count() == 0


def test_periodic_texts_keep_the_words(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    edge = spark.createDataFrame([(i, t) for i in range(100) for t in ("", None, "a", "a b", " x  y\nz ", "one two three four five six seven")], "doc_id long, text string")
    for table in (docs, edge, edge.select(edge.doc_id.cast("int").cast("long").alias("doc_id"), "text")):
        want = sorted((r.doc_id, brute.periodic_words(r.doc_id, r.text)) for r in table.collect())
        assert sorted((r.doc_id, brute.WORD.findall(r.text or "")) for r in queries.periodic_texts(table).collect()) == want


def test_query_equals_brute_force(spark, small_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, small_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_runs for r in rows)
    for r in rows:
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == brute.run_row(
            brute.periodic_words(r.doc_id, texts[r.doc_id])), r.doc_id
