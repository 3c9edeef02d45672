import math

import numpy as np
import pytest

from slotwise.llm import vectors
from tests.llm.brute import Union
from tests.llm.conftest import clash

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    union, links = Union(), {}
    sound = [(i, np.array(e, dtype=np.float64), c) for i, e, c in rows if i is not None and c is not None and e
             and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    for a, (i, x, c) in enumerate(sound):
        for j, y, d in sound[a + 1:]:
            if c == d and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                union.join(i, j)
    return {i: (links.get(i, 0), union.find(i), union.find(i) == i) for i, _, _ in rows if i is not None}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out, base = [], rng.standard_normal((40, 16)).astype(np.float32)
    for i in range(400):
        x = base[i % 40] + rng.standard_normal(16).astype(np.float32) * rng.choice([0, 0.05, 0.2, 0.3])
        out.append((i, [float(v) for v in x], int(i % 40 % 3)))
    # copies, scaled copies, huge values, and vectors that link with nothing
    out += [(400, out[0][1], 0), (401, [2 * v for v in out[0][1]], 0), (402, [float(np.float32(1e30)) * v for v in out[0][1]], 0),
            (403, None, 0), (404, [], 0), (405, [0.0] * 16, 0), (406, [None, *out[0][1][1:]], 0), (407, [float("nan"), *out[0][1][1:]], 0),
            (408, [float("inf"), *out[0][1][1:]], 0), (409, out[0][1], None), (410, out[0][1][:8], 0), (411, out[0][1], 1), (412, [-0.0] * 16, 0)]
    return out


def test_equals_brute_force(spark, rows):
    assert got(clash(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_crowded_buckets_are_cut_into_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 16)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_exact_copies(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(3000)] + [(5000, [2.0, -1.0], 1)]
    found = got(spark.createDataFrame(rows, SCHEMA))
    assert found[17] == (2999, 0, False) and found[0] == (2999, 0, True) and found[5000] == (0, 5000, True)


def test_rows_without_id_and_empty_table(spark):
    found = vectors.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], SCHEMA)).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in found] == [(0, None, True)] * 2
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_count_keeps_the_promised_recall():
    for bits in (1, 5, 12):
        agree = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - agree) ** vectors.table_count(bits, 0.93, 1e-4) <= 1e-4


def test_vectors_of_doubles(spark, rows):
    doubles = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert got(doubles) == brute([tuple(r) for r in doubles.collect()])


def test_rows_that_repeat_a_vec_id_are_one_node(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    found = vectors.near_duplicates(spark.createDataFrame([(5, x, 1), (5, y, 1), (2, [1.0, 0.01], 1), (7, [0.01, 1.0], 1)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(2, 1, 2), (5, 1, 2), (5, 1, 2), (7, 1, 2)]
