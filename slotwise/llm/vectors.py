"""Near-duplicate vectors: random-hyperplane hashing in several tables, exact cosines, connected components.

Vectors of one label are compared. Exact copies collapse to one class with a weight first. Each class gets ``bits`` sign
bits in each of ``tables`` tables; classes that agree on all bits of a table form a bucket, in which all cosines are
computed in double precision as blocked matrix products. ``bits`` follows the largest label so that a bucket expects about
``BUCKET`` vectors, and ``tables`` is the least number by which a pair at the threshold is missed with a chance of at
most ``MISS``; closer pairs are missed less often, copies never.

A pair that meets in several tables counts in the first of them only: the packed bits of all tables travel with a vector.
Buckets put out, per vector, the weight of its partners and a spanning forest of the links, never the pairs. A bucket of
more than ``CELL`` vectors is cut into chunks by a hash, and each pair of chunks is a cell, a group of its own.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with null label or null
vec_id, link with nothing and keep themselves; vectors of different lengths never link; rows that repeat a vec_id are
vectors of their own with their own links, but one node of the component graph, as components are named by ids; an empty table gives an empty table; columns other than vec_id, label and embedding are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import finished, small_batches, store
from slotwise.llm.components import connected_components

THRESHOLD = 0.93
MISS = 1e-5
BUCKET = 32
CELL = 1024
SEED = 7


def table_count(bits: int, threshold: float, miss: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def planes(dim: int, n: int) -> np.ndarray:
    """(dim, n) random hyperplanes, the same in every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def _matrix(values: pa.Array) -> np.ndarray:
    """Rows of an Arrow list array whose lists have equal lengths, in double precision."""
    return np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1)


def _codes(packed: list[bytes], bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket codes from packed bits."""
    flat = np.unpackbits(np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1), axis=1)[:, :bits * tables]
    return flat.reshape(len(packed), tables, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (root, member) of a symmetric boolean matrix, by breadth-first search."""
    left, out = linked.any(axis=1), []
    while left.any():
        root = int(left.argmax())
        left[root] = False
        front = np.flatnonzero(linked[root] & left)
        while len(front):
            left[front] = False
            out += [(root, int(i)) for i in front]
            front = np.flatnonzero(linked[front].any(axis=0) & left)
    return out


def _cell(x: np.ndarray, codes: np.ndarray, weight: np.ndarray, table: int, chunk: np.ndarray, threshold: float):
    """Weight of the partners that each vector first meets here, and a spanning forest of all links."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if chunk[0] != chunk[-1]:
        linked &= chunk[:, None] != chunk[None, :]
    if not linked.any():
        return None
    first = linked.copy()
    for t in range(table):
        if not first.any():
            break
        first &= codes[:, t, None] != codes[None, :, t]
    return first @ weight.astype(np.float64), _forest(linked)


def _sketch(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row ``(label, dim, part, code, cid, weight, packed, embedding)`` per class and table."""
    kind = classes.schema["embedding"].dataType.simpleString()

    def run(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x = _matrix(own.column(4))
                x = x / np.abs(x).max(axis=1, keepdims=True)  # doubles are a view of Arrow's memory, which is read-only
                packed = np.packbits(x @ planes(int(dim), bits * tables) > 0, axis=1)
                rows = [p.tobytes() for p in packed]
                codes, packed_column = _codes(rows, bits, tables), pa.array(rows, pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0), own.column(1), pa.array(np.full(len(own), t, dtype=np.int32)), pa.array(codes[:, t]), own.column(2),
                         own.column(3), packed_column, own.column(4)],
                        names=["label", "dim", "part", "code", "key", "weight", "packed", "embedding"])

    return classes.select("label", "dim", "key", "weight", "embedding").mapInArrow(
        run, f"label {classes.schema['label'].dataType.simpleString()}, dim int, part int, code long, key long, weight long, packed binary, embedding {kind}")


def _compare(cells: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """``(key, other, n)``: rows with ``n`` partners' weight (other null) or a forest link (n null)."""
    group = ["label", "dim", "part", "code", "ci", "cj"]
    dealt = cells.repartition(*group).sortWithinPartitions(*group, "chunk")
    out = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def finish(parts: list[pa.RecordBatch]):
        own = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        if len(own) < 2:
            return []
        found = _cell(_scaled(own), _codes(own.column(own.schema.get_field_index("packed")).to_pylist(), bits, tables),
                      own.column(own.schema.get_field_index("weight")).to_numpy(), own.column(2)[0].as_py(),
                      own.column(own.schema.get_field_index("chunk")).to_numpy(), threshold)
        if found is None:
            return []
        counts, forest = found
        keys = own.column(own.schema.get_field_index("key")).to_numpy()
        some = np.flatnonzero(counts)
        rows = [(keys[some], None, counts[some].astype(np.int64))]
        if forest:
            a, b = np.array(forest).T
            rows.append((keys[a], keys[b], None))
        return [pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.int64()) if o is None else pa.array(o),
                                            pa.nulls(len(k), pa.int64()) if n is None else pa.array(n)], schema=out) for k, o, n in rows]

    def _scaled(own: pa.RecordBatch) -> np.ndarray:
        x = _matrix(own.column(own.schema.get_field_index("embedding")))
        return x / np.abs(x).max(axis=1, keepdims=True)

    def run(batches):
        held, at = [], None
        for b in batches:
            if not len(b):
                continue
            table = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(group))]
            new = np.zeros(len(b), dtype=bool)
            for column in table:
                new[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:]):
                name = tuple(column[i] for column in table)
                if name != at and held:
                    yield from finish(held)
                    held = []
                at = name
                held.append(b.slice(i, j - i))
        if held:
            yield from finish(held)

    return dealt.select(*group, "chunk", "key", "weight", "packed", "embedding").mapInArrow(run, "key long, other long, n long")


@finished("vector-classes")
def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors(vec_id, embedding, label)``; stored, intermediates are deleted."""
    small_batches(vectors.sparkSession, 2048)
    e = F.col("embedding")
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & F.exists(e, lambda x: x != 0)
             & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("_sound"))
    rows = rows.withColumn("key", F.when(F.col("_sound"), F.xxhash64("label", F.size(e), e)))
    classes = store(rows.filter("_sound").groupBy("key").agg(
        F.first("label").alias("label"), F.first(F.size(e)).alias("dim"), F.min("vec_id").alias("cid"),
        F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")), "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(largest / BUCKET, 1))))
    tables = table_count(bits, threshold, miss)
    sketch = _sketch(classes, bits, tables)
    bucket = ["label", "dim", "part", "code"]
    crowded = store(sketch.groupBy(*bucket).count().filter(F.col("count") > CELL).select(
        *[F.col(c).alias(f"_{c}") for c in bucket], F.ceil(F.col("count") / CELL).cast("int").alias("_chunks")), "crowded")
    met = sketch.join(crowded, [F.col(c) == F.col(f"_{c}") for c in bucket], "left")
    met = met.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("key"), F.col("_chunks")).cast("int"), F.lit(0)))
    met = met.withColumn("_j", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
    cells = met.withColumn("ci", F.least("chunk", "_j")).withColumn("cj", F.greatest("chunk", "_j"))
    found = store(_compare(cells, bits, tables, threshold), "vector-links")
    counts = found.filter("other IS NULL").groupBy("key").agg(F.sum("n").alias("_partners"))
    name = classes.select("key", "cid")
    links = (found.filter("other IS NOT NULL").select("key", "other").distinct().join(name, "key").select("other", F.col("cid").alias("a"))
             .join(name, F.col("other") == F.col("key")).select("a", F.col("cid").alias("b")))
    component = connected_components(links)
    per_class = (classes.select("key", "cid", "weight").join(counts, "key", "left").join(component, F.col("cid") == F.col("node"), "left")
                 .select(F.col("key").alias("_key"), (F.col("weight") - 1 + F.coalesce("_partners", F.lit(0))).alias("n_links"),
                         F.coalesce("component", "cid").alias("component_id")))
    out = rows.select("vec_id", "key").join(per_class, F.col("key") == F.col("_key"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
