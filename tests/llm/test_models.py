"""Language ID, toxicity and quality rules on small tables with nulls, empty texts, repeats and clashing columns."""

import itertools
import pickle
import random
import tracemalloc

import numpy as np
import pytest

from slotwise.llm import langid, quality, toxicity
from tests.llm import brute

LABELS = "doc_id long, quality int, toxic int"


def test_language_id_rows(repeated, empty):
    rows = langid.identify(repeated).collect()
    assert len(rows) == repeated.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (5, 6, 7, 16))
    assert all(r.lang_pred in {"en", "de", "es", "und"} and 0 <= r.score <= 1 for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2)}) == 1
    assert by_id[None].held_out
    kept = langid.accepted(repeated)
    assert kept.columns == repeated.columns and not {5, 6, 7, 16} & {r.doc_id for r in kept.collect()}
    assert langid.identify(empty).count() == 0 and langid.accepted(empty).count() == 0


def test_language_id_without_labels(spark):
    rows = langid.identify(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def test_presence_does_not_depend_on_stretches(monkeypatch):
    seen = np.zeros(langid.DIM, dtype=np.uint8)
    text = "Ein kurzer Satz, 漢字 🙂 und mehr. " * 40
    whole = langid.presence(text, seen)
    monkeypatch.setattr(langid, "STRETCH", 17)
    assert np.array_equal(whole, langid.presence(text, seen)) and not seen.any()


def test_marginals_equal_enumeration():
    """Forward-backward with skipped stretches against the sum over all taggings."""
    rng = np.random.default_rng(4)
    model = toxicity.Model({"bad$": 2.0, "wors": 1.0}, -1.5, rng.normal(size=(2, 2)), rng.normal(size=2))
    tagger = toxicity.Tagger(model)
    for words in (["bad"], ["x", "bad"], ["x", "x", "x", "bad", "worse", "x", "x", "bad"], ["bad", "x", "x", "x", "x"]):
        at, got, n = tagger.tag(" ".join(words))
        weight = [model.other + sum(model.feature.get(f, 0) for f in toxicity.features(w)) for w in words]
        total, toxic = 0.0, np.zeros(len(words))
        for tags in itertools.product((0, 1), repeat=len(words)):
            score = model.start[tags[0]] + sum(w for w, t in zip(weight, tags) if t) + sum(model.move[a, b] for a, b in zip(tags, tags[1:]))
            total += np.exp(score)
            toxic += np.exp(score) * np.array(tags)
        assert n == len(words) and np.allclose(got, (toxic / total)[at])


@pytest.fixture(scope="module")
def toxic_docs(spark):
    clean = [(i, f"plain words number {i % 7} about nothing, part {i % 5} of it", 1, 0) for i in range(300)]
    near = ["amid", "by", "on", "in", "at", "up", "to", "of", "as", "so"]  # copies of one context would count once
    bad = [(1000 + i, f"plain words {near[i % 10]} FOOL{'' if i % 2 else ','} {near[i // 10]} number {i % 7} of nothing", 1, 1) for i in range(100)]
    odd = [(2000, None, None, None), (2001, "", 1, 0), (2002, "fool " * 4000, None, None), (None, "you fool", 1, 1)]
    rows = clean + bad + odd
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(r[0], *r[2:]) for r in rows + bad[:5]], LABELS))


def test_toxicity_rows_and_spans(toxic_docs):
    docs, labels = toxic_docs
    rows = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(rows[i].predicted == 0 and not rows[i].spans for i in range(300))
    assert all(rows[1000 + i].predicted == 1 for i in range(100))
    start, end = rows[1001].spans[0]
    assert "plain words by FOOL amid number"[start:end] == "FOOL"
    assert rows[2000].score == rows[2001].score and rows[2002].predicted == 1 and rows[None].held_out


def test_toxicity_without_labels_or_rows(spark, toxic_docs):
    docs, labels = toxic_docs
    rows = toxicity.classify(docs, labels.limit(0)).collect()
    assert len(rows) == docs.count() and all(r.score < 1e-6 and r.predicted == 0 for r in rows)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_quality_rows(spark, repeated, edge_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 1, 0), (15, 0, 0), (None, 1, 0), (4, None, None)], LABELS)
    rows = quality.judge(repeated, labels).collect()
    assert len(rows) == repeated.count()
    want = {r[0]: brute.quality_counts(r[1]) for r in edge_rows}
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].base_failed and by_id[6].score == 0 and by_id[1].kept and by_id[2].kept
    assert quality.judge(empty, labels).count() == 0


def test_quality_without_target(spark, edge):
    rows = quality.judge(edge, spark.createDataFrame([], LABELS)).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in rows)


def test_quality_plan_has_no_python(spark, edge):
    plan = quality.judge(edge, spark.createDataFrame([], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_samples_hold_one_row_of_an_id(spark):
    """One id repeated 5,000 times neither fills the samples nor keeps other ids out."""
    rows = [(1, f"text {i}", "en") for i in range(5000)] + [(10 + i, f"other text {i}", "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 1) for i in {r[0] for r in rows}], LABELS)
    for sample in (langid.training_sample(docs), toxicity.training_sample(docs, labels)):
        found = {r.doc_id: r.text for r in sample.collect()}
        assert sample.count() == len(found) > 30 and found.get(1, "text 0") == "text 0"
    assert toxicity.training_sample(docs, labels, 7).count() == 7


def test_language_scores_equal_exact_kernel_ridge(spark, monkeypatch):
    """With every sample text a landmark, Nystrom features give what the dual of the weighted ridge gives on the whole kernel."""
    docs = [(i, t, lang) for i, (t, lang) in enumerate([(f"the {a} and the {b}", "en") for a in ("cat", "dog", "hen") for b in ("cow", "pig")]
                                                       + [(f"der {a} und das {b}", "de") for a in ("Hund", "Vogel") for b in ("Haus", "Boot")] * 2)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(table, landmarks=1000)
    seen = np.zeros(langid.DIM, dtype=np.uint8)
    grams = lambda t: set(langid.presence(t, seen).tolist())
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    sample = sorted(((r.lang, grams(r.text)) for r in langid.training_sample(table).collect()), key=lambda r: (r[0], sorted(r[1])))
    k = np.array([[kernel(a, b) for _, b in sample] for _, a in sample])
    names = np.array([lang for lang, _ in sample])
    goal = np.where(names[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    w = np.sqrt(len(names) / (len(model.languages) * np.array([(names == n).sum() for n in names])))
    ridge = langid.RIDGE * len(names) / len(model.languages)
    alpha = np.linalg.solve(w[:, None] * k * w[None, :] + ridge * np.eye(len(names)), w[:, None] * goal)
    for text in ("the dog", "das Boot und der Hund", "nothing like it", "and der"):
        want = (np.array([kernel(grams(text), b) for _, b in sample]) * w) @ alpha
        assert np.allclose(model.scores([langid.presence(text, seen)])[0], want, atol=2e-3)


def test_document_score_from_enumerated_marginals():
    model = toxicity.Model({"bad$": 2.0}, -1.0, np.array([[0.5, -0.5], [0.2, 0.1]]), np.array([0.3, -0.2]), (-3.0, 4.0, 1.5))
    tagger = toxicity.Tagger(model)
    words, marks = "x bad y bad bad".split(), []
    for place in (1, 3, 4):
        total = toxic = 0.0
        for tags in itertools.product((0, 1), repeat=5):
            s = model.start[tags[0]] + sum((model.other + model.feature.get(f"{w}$", 0)) for w, t in zip(words, tags) if t)
            s += sum(model.move[a, b] for a, b in zip(tags, tags[1:]))
            total, toxic = total + np.exp(s), toxic + np.exp(s) * tags[place]
        marks.append(toxic / total)
    want = 1 / (1 + np.exp(3.0 - 4.0 * max(marks) - 1.5 * np.log1p(sum(marks))))
    assert np.isclose(tagger.document(tagger.tag(" ".join(words))[1]), want)


def quality_scores(docs, good):
    """{doc_id: score} by plain counting: hashed uni- and bigrams, additive smoothing, mean log ratio."""
    import collections
    import math

    import xxhash

    def grams(text):
        w = brute.WORD.findall(text or "")
        one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        return [h % quality.BUCKETS for h in one + [xxhash.xxh64_intdigest(y.encode(), h) for h, y in zip(one, w[1:])]]

    signed = lambda t: [g for g in grams(t)]  # noqa: E731  2**64 is a multiple of BUCKETS, so the sign does not matter
    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(signed(t))
        if i in good:
            target.update(signed(t))
    n_raw, n_target, s, size = sum(raw.values()), sum(target.values()), quality.SMOOTHING, quality.BUCKETS
    ratio = lambda g: round(math.log((target[g] + s) / (n_target + s * size)) - math.log((raw[g] + s) / (n_raw + s * size)), 4)
    return {i: sum(map(ratio, signed(t))) / max(1, len(signed(t))) for i, t in docs}


def test_quality_scores_equal_brute_force(spark, edge, edge_rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 60)], LABELS)
    good = {r[0] for r in quality.target_ids(edge, labels).collect()}
    want = quality_scores([r[:2] for r in edge_rows], good)
    rows = quality.judge(edge, labels, threshold=-0.5).collect()
    assert good and all(abs(r.score - want[r.doc_id]) < 1e-3 for r in rows)
    assert all(r.kept == (not r.base_failed and r.score >= -0.5) for r in rows)


def test_quality_result_can_be_filtered(spark, edge, edge_rows):
    """A filter on any column stays above the counts; moved down it would repeat them for each word of a text."""
    rows = quality.judge(edge, spark.createDataFrame([(i, 1, 0) for i in range(1, 60)], LABELS), threshold=-0.5)
    n = len(edge_rows)
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"):
        assert rows.filter(f"{c} >= -1000").count() == n
    assert rows.filter("base_failed").count() + rows.filter("NOT base_failed").count() == n
    assert rows.filter("kept").count() == sum(r.kept for r in rows.collect())
    assert rows.filter("doc_id = 1 AND n_repeat_words >= 0 AND NOT base_failed AND kept").count() == 1


def test_powers_beyond_the_table_equal_repeated_products():
    model = toxicity.Model({"bad$": 2.0}, -0.01, np.array([[0.02, -0.01], [-0.03, 0.01]]), np.zeros(2))
    tagger, one = toxicity.Tagger(model), np.exp(model.move + np.array([0.0, model.other]))
    for gap in (toxicity.POWERS, toxicity.POWERS + 1, 1000, 12_345):
        want = np.eye(2)
        for _ in range(gap):
            want = want @ one
            want /= want.max()
        assert np.allclose(np.array(tagger.power(gap)).reshape(2, 2) / max(tagger.power(gap)), want, rtol=1e-9)


def test_language_fit_never_holds_the_dense_sample(spark):
    """The driver opens few bit maps at a time and keeps none dense: 600 dense vectors alone would be 79 MB."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["haus", "garten", "und"] if i % 2 else ["house", "garden", "and"], k=9)) + f" {i}", "de" if i % 2 else "en")
            for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.training_sample(table).count() == 600
    tracemalloc.start()
    try:
        model = langid.fit(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6 and len(pickle.dumps(model)) < 1e6
    assert all((r.lang_pred == "de") == r.doc_id % 2 for r in langid.predict(table, model).collect())
