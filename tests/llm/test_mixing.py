import collections

import pytest

from slotwise.llm import mixing
from tests.llm.conftest import DOCS


def water_fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by the rule's words: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: target[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            cap = float(most * sizes[s])
            target[s] = min(share[s], cap)
            left += share[s] - target[s]
            if share[s] >= cap:
                open_.discard(s)
    return target


def check(df):
    rows = mixing.mix(df).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = water_fill(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    biggest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 3 * biggest[s] for s in sizes)
    return rows


def test_edge_rows_and_repeats(repeated, edge, empty):
    rows = check(edge)
    assert len(rows) == edge.count() and [r.size for r in rows if r.doc_id in (5, 6, 7)] == [0, 0, 0]
    assert len(check(repeated)) == repeated.count()
    assert mixing.mix(empty).count() == 0


def test_caps_cascade(spark):
    rows = [(i, "w " * 10, None, "a", 0) for i in range(50)] + [(100 + i, "w", None, "c", 0) for i in range(3)] + [
        (200, "w w", None, "b", 0), (201, "", None, "d", 0), (202, None, None, None, 0)]
    check(spark.createDataFrame(rows, DOCS))


def test_hot_source_comes_near_its_target(spark):
    rows = [(i, "w " * (1 + i % 37), None, "hot" if i % 3 else f"s{i % 11}", 0) for i in range(3000)]
    found = check(spark.createDataFrame(rows, DOCS))
    hot = [r for r in found if r.source == "hot"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) <= 0.02 * hot[0].target


@pytest.mark.parametrize("fixture", ["edge", "repeated"])
def test_emitted_rows_agree_with_the_mix_and_reruns(request, fixture):
    df = request.getfixturevalue(fixture)
    copies = collections.Counter()
    for r in mixing.mix(df).collect():
        copies[r.doc_id] += r.copies
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = collections.Counter(r.doc_id for r in out.collect())
    assert got == +copies
    assert got == collections.Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
