import numpy as np
from pyspark.sql import functions as F

from slotwise.llm import linededup
from tests.llm import brute


def found(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in df.collect()}


def rows_of(df):
    return {tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()}


def test_equals_brute_force(edge, edge_rows):
    assert found(linededup.dedupe_lines(edge)) == brute.dedupe_lines([r[:2] for r in edge_rows])


def test_repeated_rows_null_ids_and_clashing_columns(repeated, edge_rows, empty):
    out = linededup.dedupe_lines(repeated)
    assert set(out.columns) == set(repeated.columns) | {"n_lines", "n_dropped"} and out.count() == repeated.count()
    want = brute.dedupe_lines([r[:2] for r in edge_rows])
    assert {k: v for k, v in found(out).items() if k is not None} == want
    assert linededup.dedupe_lines(empty).count() == 0


def test_deletion_undoes_insertion(spark, edge):
    whole = linededup.build(edge)
    gone = edge.filter("doc_id % 2 = 0 OR doc_id = 1")
    less = linededup.delete(whole, gone.select("doc_id"))
    rest = edge.join(gone.select("doc_id"), "doc_id", "left_anti")
    assert rows_of(less.counts) == rows_of(linededup.count_keys(linededup.postings(rest)))
    assert found(linededup.apply(rest, less)) == brute.dedupe_lines([(r.doc_id, r.text) for r in rest.collect()])
    again = linededup.insert(less, linededup.postings(gone))
    assert rows_of(again.counts) == rows_of(whole.counts)
    same = linededup.delete(whole, spark.createDataFrame([(10**9,), (None,)], "doc_id long"))
    assert rows_of(same.counts) == rows_of(whole.counts)


def test_filters_know_every_key(edge):
    state = linededup.build(edge, parts=3)
    tables = {r.shard: linededup.Cuckoo.load(bytes(r.cuckoo)) for r in state.filters.collect()}
    for r in state.counts.select("key", linededup._shard(F.col("key"), state.shards).alias("shard")).collect():
        assert tables[r.shard].has(np.frombuffer(bytes(r.key), dtype="<u8").reshape(1, 2)).all()


def test_cuckoo_filter_grows_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (6000, 2), dtype=np.uint64)
    table = linededup.Cuckoo(500)
    for part in np.split(keys, 12):
        table.add(part)
    assert table.has(keys).all() and len(table.tables) > 1
    assert table.has(rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)).mean() < 0.01
    table = linededup.Cuckoo.load(table.dump())
    table.remove(keys[:3000])
    assert table.has(keys[3000:]).all() and table.has(keys[:3000]).mean() < 0.01
    table.remove(keys[3000:])
    assert not any(t.any() for t in table.tables)


def test_many_shared_lines_take_linear_time(spark):
    text = "\n".join(f"this is shared line {i}" for i in range(200_000))
    rows = spark.createDataFrame([(1, text + "\nown"), (2, f"first\n{text}\n{text}\nlast")], "doc_id long, text string").repartition(2)
    assert found(linededup.dedupe_lines(rows)) == {1: (200_001, 0, text + "\nown"), 2: (400_002, 400_000, "first\nlast")}
