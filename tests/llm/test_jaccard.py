import collections
import random
from pathlib import Path

import numpy as np
import pytest

from slotwise.llm import common, jaccard
from slotwise.llm.components import connected_components
from tests.llm import brute
from tests.llm.conftest import DOCS, sentence


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(edge, edge_rows):
    assert found(jaccard.near_duplicates(edge)) == brute.jaccard_components([r[:2] for r in edge_rows])


@pytest.fixture(scope="module")
def families(spark):
    """Chains and clouds of near copies with few and many changes, of texts long and short, and texts built of shared lines."""
    rng, rows = random.Random(9), []
    lines = [sentence(rng, 12) for _ in range(6)]
    for _ in range(12):
        words = sentence(rng, rng.choice([5, 6, 9, 30, 120])).split()
        for _ in range(10):
            if rng.random() < 0.8:
                k = rng.randrange(len(words))
                words = words[:k] + [sentence(rng, 1)] + words[k + rng.choice([0, 1]):]
            rows.append((len(rows), " ".join(words), "en", "a", 0))
    rows += [(len(rows) + i, "\n".join(rng.sample(lines, rng.randint(3, 6))), "en", "a", 0) for i in range(60)]
    return rows


def test_families_of_near_copies(spark, families):
    want = brute.jaccard_components([r[:2] for r in families])
    assert len({c for _, c in want.values()}) < len(want)
    assert found(jaccard.near_duplicates(spark.createDataFrame(families, DOCS))) == want


def test_matrix_alone_finds_all_links(spark, families, monkeypatch):
    """Without the min-hash stars every link between different sets must come from the token-group matrix."""
    monkeypatch.setattr(jaccard, "ALIKE", jaccard.SKETCH + 1)
    monkeypatch.setattr(jaccard, "OFTEN", 3)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    monkeypatch.setattr(jaccard, "BUCKET", 300)
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    assert found(jaccard.near_duplicates(spark.createDataFrame(families, DOCS))) == brute.jaccard_components([r[:2] for r in families])


def test_repeated_rows_null_ids_and_empty_table(repeated, edge_rows, empty):
    rows = jaccard.near_duplicates(repeated).collect()
    assert len(rows) == repeated.count()
    want = brute.jaccard_components([r[:2] for r in edge_rows])
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.one_of_each(repeated)
    assert kept.columns == repeated.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert kept.filter("doc_id IS NULL").count() == 2


def test_long_texts_are_cut_without_losing_shingles(monkeypatch):
    text = " ".join(f"w{i % 977}  x{i % 13}\n" for i in range(4000))
    whole = jaccard.shingles(text)
    monkeypatch.setattr(jaccard, "_PIECE", 100)
    assert np.array_equal(whole, jaccard.shingles(text))
    assert len(whole) == len(brute.shingle_set(text))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (2000, 1999)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {1999: 1999, 2000: 1999}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def nodes(rows):
    """Components by doc_id, where rows that share a doc_id are one node."""
    union, sets = brute.Union(), [(i, brute.shingle_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        union.find(i)
        for j, b in sets[k + 1:]:
            if a & b and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    return sorted((i, len(s), union.find(i)) for i, s in sets)


def texts_left(rows):
    """One text, of the least doc_id, for each group of linked texts."""
    texts = sorted(set(rows), key=lambda r: (r[0], r[1]))
    found = brute.jaccard_components(list(enumerate(t for _, t in texts)))
    return collections.Counter(texts[min(k for k in found if found[k][1] == c)][0] for c in {c for _, c in found.values()})


def repeated_ids(seed):
    rng = random.Random(seed)
    texts = [sentence(rng, 12) for _ in range(8)]
    texts += [" ".join([*t.split()[:-1], "z"]) for t in texts[:4]] + ["", "one"]
    return [(rng.randrange(12), rng.choice(texts)) for _ in range(30)]


@pytest.mark.parametrize("rows", [[(0, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (3, "u v w x y z")], *map(repeated_ids, range(3))])
def test_rows_that_share_a_doc_id(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()) == nodes(rows)
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()]
    assert collections.Counter(i for i, _ in kept) == texts_left(rows)
    for text in {t for _, t in rows}:  # every text has a near copy, or itself, among the kept ones
        own = brute.shingle_set(text)
        reach = {c for _, (_, c) in brute.jaccard_components(list(enumerate([text, *[t for _, t in rows]]))).items()}
        assert not own or any(t == text for _, t in kept) or len(reach) < len(rows) + 1


def stored(spark):
    return {p.name for p in Path(common.shared_dir(spark).removeprefix("file:")).glob("llm-*")}


def test_only_the_result_stays_in_the_shared_folder(spark, edge, edge_rows, empty):
    before, settings = stored(spark), [spark.conf.get(s, None) for s in common.SETTINGS]
    result = jaccard.near_duplicates(edge)
    assert {n.rsplit("-", 1)[0] for n in stored(spark) - before} == {"llm-near-duplicates"}
    assert [spark.conf.get(s, None) for s in common.SETTINGS] == settings
    assert found(result) == brute.jaccard_components([r[:2] for r in edge_rows])
    jaccard.near_duplicates(empty)
    assert len(stored(spark) - before) == 2


def test_a_failed_call_leaves_nothing_behind(spark, edge, monkeypatch):
    def fail(*_):
        raise RuntimeError("no links today")

    before, settings = stored(spark), [spark.conf.get(s, None) for s in common.SETTINGS]
    monkeypatch.setattr(jaccard, "_star_links", fail)
    with pytest.raises(RuntimeError, match="no links today"):
        jaccard.near_duplicates(edge)
    assert stored(spark) == before
    assert [spark.conf.get(s, None) for s in common.SETTINGS] == settings
