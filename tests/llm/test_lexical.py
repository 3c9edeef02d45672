import random

import pytest

from slotwise.llm import lexical, queries
from tests.llm import brute
from tests.llm.conftest import DOCS, clash

ITEMS = "item_id long, text string"


def found(df):
    rows = df.collect()
    out = {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def pairs(df):
    return [(r[0], r[1]) for r in df.select(*df.columns[:2]).collect()]


@pytest.fixture(scope="module")
def asked(spark, edge_rows):
    rows = [(1, edge_rows[0][1]), (2, "ONE"), (3, "漢字 ñandú, 12"), (4, None), (5, ""), (6, "no-such-term ..."), (None, "line shared"), (7, "a b"), (7, "c x"),
            (8, " ".join(edge_rows[12][1].split()[:80])), (8, "one")]
    return spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize("table", ["edge", "repeated"])
@pytest.mark.parametrize("block, seeds", [(4096, 8), (3, 1)])
def test_edge_rows_equal_brute_force(request, asked, table, block, seeds):
    docs = request.getfixturevalue(table)
    got = found(lexical.search(lexical.build(docs, block), asked, seeds=seeds))
    assert got == brute.search(pairs(docs), pairs(asked))


def test_empty_tables(spark, empty, edge, asked):
    nothing = spark.createDataFrame([], ITEMS)
    assert lexical.search(lexical.build(empty), asked).count() == 0
    assert lexical.search(lexical.build(edge), nothing).count() == 0
    assert lexical.search(lexical.build(empty), nothing).columns == ["item_id", "rank", "doc_id", "score"]


def test_random_tables_with_ties_and_a_hot_stratum(spark):
    rng = random.Random(3)
    word = lambda: f"w{min(int(rng.expovariate(0.2)), 60)}"
    docs = [(i, " ".join(word() for _ in range(20 if i % 3 else rng.randint(1, 200)))) for i in range(600)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(60)]  # copies: equal scores
    rows = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(40)]
    index = lexical.build(rows, block=50)
    assert found(lexical.search(index, spark.createDataFrame(items, ITEMS), seeds=2)) == brute.search(docs, items)
    assert found(lexical.search(index, spark.createDataFrame(items, ITEMS), k=3)) == brute.search(docs, items, 3)


def test_index_holds_every_document_and_term(edge, edge_rows):
    index = lexical.build(clash(edge), block=4)
    blocks = {r.block: r for r in index.blocks.collect()}
    assert all(1 <= len(r.doc_ids) <= 4 for r in blocks.values())
    got = {}
    for r in index.postings.collect():
        for place in r.docs:
            got.setdefault(blocks[r.block].doc_ids[place], {})[r.term] = r.tf
            assert blocks[r.block].m == r.m
    want = {i: dict(brute.collections.Counter(brute.TERM.findall((t or "").translate(brute.LOWER)))) for i, t, *_ in edge_rows}
    assert got == {i: c for i, c in want.items() if c}
    assert (index.documents, index.terms) == (len(got), sum(sum(c.values()) for c in got.values()))


def test_blocks_below_the_threshold_are_not_visited(spark, monkeypatch):
    """A rare term held with high tf in one stratum: after the first visit no other block can reach its score."""
    docs = [(i, "rare " * 50, None, None, 0) for i in range(12)] + [(100 + i, "rare " + "common " * (i + 60), None, None, 0) for i in range(300)]
    visits, real = [], lexical._visit
    monkeypatch.setattr(lexical, "_visit", lambda v, *a: visits.append(v.count()) or real(v, *a))
    index = lexical.build(spark.createDataFrame(docs, DOCS), block=20)
    got = found(lexical.search(index, spark.createDataFrame([(1, "rare")], ITEMS), seeds=1))
    assert [got[1, r][0] for r in range(1, 11)] == list(range(10))
    assert visits == [1, 0] and index.blocks.count() > 100


def test_query_equals_brute_force(spark, small_dir):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{small_dir}/{t}.parquet").select(c, "text").collect()]
    assert found(queries.op12_lexical_search(spark, small_dir)) == brute.search(read("documents", "doc_id"), read("benchmark", "item_id"))
