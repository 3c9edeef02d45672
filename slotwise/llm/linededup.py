"""Incremental, reversible line deduplication.

The state is three tables, dealt into shards by line key:

* ``postings(key, doc_id)``: which documents hold which keys;
* ``counts(key, n_docs, owner)``: the exact number of documents of each key and the least of them;
* ``filters(shard, cuckoo)``: one cuckoo filter per shard with the fingerprints of its keys.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in lower case; it is kept as its
128-bit MD5. Keys shorter than ``MIN_KEY`` code points never count.

Insertion counts a batch's keys (pre-aggregated, so that a key of a third of all documents is one row per task), then
asks the filters: a key they do not know is new and is appended unseen; only the others are joined with the exact counts.
Deletion subtracts a batch's counts; keys that reach zero leave the filter, others whose owner left get the least
remaining document. After inserting and deleting the same documents the state is as before.

A filter holds 16-bit fingerprints in buckets of four; what no longer fits goes to a further, larger table of the same
shard, so growing needs no keys again. A key that the filter wrongly knows is found missing in the exact counts; its
fingerprint is then added too, so later deletions of another key cannot hide it. A shard holds ``SHARD_KEYS`` keys on
average; the number of shards follows the number of keys.

Decision: a key in at least two documents loses all its lines except those of its owner.

Cases: null and empty texts are one empty line; rows of one doc_id count as one document and share its decisions, null
doc_ids count as one document that sorts last; an empty table gives an empty state; other columns pass through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import SPACES, lower_ascii, store

MIN_KEY = 10
SHARD_KEYS = 20_000
MAX_KICKS = 200
_SPACES = SPACES.encode()
FULL = 0.9  # share of a table's cells that is filled before the next table begins


class Cuckoo:
    """Cuckoo filter over 128-bit keys: no false negatives, deletable, growing by further tables."""

    def __init__(self, expect: int = 0, tables: list[np.ndarray] | None = None) -> None:
        self.tables = [self.blank(expect)] if tables is None else tables

    @staticmethod
    def blank(expect: int) -> np.ndarray:
        return np.zeros((1 << max(2, int(np.ceil(np.log2(max(expect, 1) / 4 / 0.8)))), 4), dtype="<u2")

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        n = int.from_bytes(data[:4], "little")
        sizes = np.frombuffer(data, dtype="<u4", count=n, offset=4)
        cells = np.frombuffer(data, dtype="<u2", offset=4 + 4 * n)
        ends = np.cumsum(sizes.astype(np.int64) * 4)
        return cls(tables=[x.reshape(-1, 4).copy() for x in np.split(cells, ends[:-1])])

    def dump(self) -> bytes:
        sizes = np.array([len(t) for t in self.tables], dtype="<u4")
        return len(sizes).to_bytes(4, "little") + sizes.tobytes() + b"".join(t.tobytes() for t in self.tables)

    @staticmethod
    def _shift(mark, buckets: int):
        return (np.asarray(mark, dtype=np.int64) * 0x5BD1E995) & (buckets - 1)

    def _places(self, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (keys[:, 0] & np.uint64(len(table) - 1)).astype(np.int64)
        return mark, one, one ^ self._shift(mark, len(table))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        for table in self.tables:
            mark, one, two = self._places(keys, table)
            found |= ((table[one] == mark[:, None]) | (table[two] == mark[:, None])).any(axis=1)
        return found

    def add(self, keys: np.ndarray) -> None:
        while len(keys):
            last = self.tables[-1]
            room = max(0, int(last.size * FULL) - int(np.count_nonzero(last)))
            keys = np.concatenate((self._fill(keys[:room], last), keys[room:]))
            if len(keys):  # moving fingerprints about in a nearly full table is slow and mostly fails
                self.tables.append(self.blank(max(len(keys), 2 * last.size)))

    def _fill(self, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Insert what fits; the keys that do not."""
        mark, one, two = self._places(keys, table)
        rest = np.arange(len(keys))
        for at in (one, two):  # at first all at once: the n-th newcomer of a bucket takes its n-th free cell
            order = rest[np.argsort(at[rest], kind="stable")]
            spot = at[order]
            nth = np.arange(len(spot)) - np.searchsorted(spot, spot)
            free = table[spot] == 0
            cell = free & (np.cumsum(free, axis=1) - 1 == nth[:, None])
            fits = cell.any(axis=1)
            table[spot[fits], cell[fits].argmax(axis=1)] = mark[order[fits]]
            rest = np.sort(order[~fits])
        failed = [i for i in rest.tolist() if not self._kick(int(mark[i]), int(two[i]), table)]
        return keys[failed]

    def _kick(self, mark: int, bucket: int, table: np.ndarray) -> bool:
        """Move fingerprints along until one finds a free cell; without success everything stays as it was."""
        path = []
        for turn in range(MAX_KICKS):
            row = table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                return True
            cell = turn & 3
            path.append((bucket, cell))
            row[cell], mark = mark, int(row[cell])
            bucket ^= int(self._shift(mark, len(table)))
        for bucket, cell in reversed(path):
            table[bucket, cell], mark = mark, int(table[bucket, cell])
        return False

    def remove(self, keys: np.ndarray) -> None:
        """Delete one fingerprint of each key; the keys must have been added."""
        for key in keys:
            for table in self.tables:
                mark, one, two = (int(x[0]) for x in self._places(key[None], table))
                at = next((b for b in (one, two) if (table[b] == mark).any()), None)
                if at is not None:
                    table[at, np.flatnonzero(table[at] == mark)[0]] = 0
                    break


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def postings(docs: DataFrame) -> DataFrame:
    """``(doc_id, key)``: the distinct keys of each row of ``docs(doc_id, text)``."""
    keys = F.array_distinct(F.filter(F.transform(lines(F.col("text")), line_key), lambda k: F.length(k) >= MIN_KEY))
    return docs.select("doc_id", F.explode(keys).alias("_line")).select("doc_id", F.unhex(F.md5(F.col("_line").cast("binary"))).alias("key"))


@dataclass
class State:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def shards_for(n_keys: int) -> int:
    return max(1, -(-n_keys // SHARD_KEYS))


def empty_state(held: DataFrame, shards: int) -> State:
    """The state without documents; ``held(doc_id, key)`` only names the columns' types."""
    none = held.limit(0)
    counts = none.select("key", F.lit(0).cast("long").alias("n_docs"), F.col("doc_id").alias("owner"))
    return State(none, counts, none.select(F.lit(0).alias("shard"), F.col("key").alias("cuckoo")), shards)


def count_keys(held: DataFrame) -> DataFrame:
    """``(key, n_docs, owner)``: exact number of documents and least document of each key of ``held(doc_id, key)``."""
    return held.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("owner"))


def _halves(keys: pa.Array) -> np.ndarray:
    """(n, 2) 64-bit halves of an Arrow array of 16-byte values."""
    ends = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset:keys.offset + len(keys) + 1]
    return np.frombuffer(keys.buffers()[2], dtype="<u8", count=(int(ends[-1]) - int(ends[0])) // 8, offset=int(ends[0])).reshape(-1, 2)


_FLAGGED = "shard int, cuckoo binary, key binary, n_docs long, owner long, known boolean"


def _through_filters(state: State, batch: DataFrame, kind: str) -> DataFrame:
    """Deal ``batch(key, n_docs, owner)`` to the shards' filters; rows (shard, cuckoo) and (key, n_docs, owner, known) come out.

    ``insert`` adds the keys that are unknown, ``add`` adds and ``remove`` deletes all. Within a shard the filter's row
    comes first and the keys stream past it, so a task holds one filter and one Arrow batch.
    """
    none = lambda t: F.lit(None).cast(t)
    rows = batch.select(_shard(F.col("key"), state.shards).alias("shard"), F.lit(1).alias("kind"), none("binary").alias("cuckoo"),
                        "key", "n_docs", "owner")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"))
    stored = sizes.join(state.filters.withColumnRenamed("shard", "_at"), F.col("shard") == F.col("_at"), "full").select(
        F.coalesce("shard", "_at").alias("shard"), F.lit(0).alias("kind"), "cuckoo", none("binary").alias("key"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), none("long").alias("owner"))
    met = rows.unionByName(stored).repartition("shard").sortWithinPartitions("shard", "kind")
    schema = pa.schema([("shard", pa.int32()), ("cuckoo", pa.binary()), ("key", pa.binary()), ("n_docs", pa.int64()),
                        ("owner", pa.int64()), ("known", pa.bool_())])

    def run(batches):
        table, at = None, None

        def closed():
            own = [] if table is None else [{"shard": at, "cuckoo": table.dump()}]
            return pa.RecordBatch.from_pylist(own, schema=schema)

        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts, cuts[1:]):
                part = b.slice(i, j - i)
                if j > i and shard[i] != at:
                    yield closed()
                    at, data = int(shard[i]), part.column(2)[0].as_py()
                    table = Cuckoo.load(data) if data else Cuckoo(part.column(4)[0].as_py())
                    part = part.slice(1)
                if not len(part):
                    continue
                keys = _halves(part.column(3))
                known = table.has(keys)
                if kind == "remove":
                    table.remove(keys)
                else:
                    table.add(keys[~known] if kind == "insert" else keys)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(len(keys), pa.binary()), part.column(3), part.column(4),
                                                  part.column(5), pa.array(known)], schema=schema)
        yield closed()

    return met.mapInArrow(run, _FLAGGED)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _filters(flagged: DataFrame) -> DataFrame:
    return flagged.filter("cuckoo IS NOT NULL").select("shard", "cuckoo")


def insert(state: State, held: DataFrame) -> State:
    """The state with the postings ``held(doc_id, key)`` of documents that it does not hold yet."""
    flagged = store(_through_filters(state, count_keys(held), "insert"), "line-insert")
    rows = flagged.filter("cuckoo IS NULL")
    fresh = rows.filter(~F.col("known")).select("key", "n_docs", "owner")
    again = rows.filter("known").select("key", F.col("n_docs").alias("_more"), F.col("owner").alias("_their"), F.lit(True).alias("_again"))
    met = store(state.counts.join(again, "key", "full"), "line-met")
    merged = met.select("key", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("n_docs"),
                        F.least("owner", "_their").alias("owner"))
    counts = merged.unionByName(fresh)
    # keys that the filter wrongly knew are not in it yet
    missed = met.filter("_again AND n_docs IS NULL").select("key", F.col("_more").alias("n_docs"), F.col("_their").alias("owner"))
    between = State(state.postings, counts, _filters(flagged), state.shards)
    filters = store(_filters(_through_filters(between, missed, "add")), "line-filters")
    return State(state.postings.unionByName(held), counts, filters, state.shards)


def delete(state: State, doc_ids: DataFrame) -> State:
    """The state without the documents ``doc_ids(doc_id)``; ids that it does not hold change nothing."""
    gone_ids = doc_ids.select(F.col("doc_id").alias("_gone")).distinct()
    is_gone = F.col("doc_id").eqNullSafe(F.col("_gone"))
    rest = store(state.postings.join(gone_ids, is_gone, "left_anti"), "line-postings")
    gone = store(count_keys(state.postings.join(gone_ids, is_gone, "left_semi")), "line-gone").select(
        "key", F.col("n_docs").alias("_less"), F.col("owner").alias("_their"))
    # only keys that lose their owner need their postings again
    touched = state.counts.join(gone, "key", "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("_less", F.lit(0)))
    touched = store(touched, "line-touched")
    orphan = touched.filter("n_docs > 0 AND _less IS NOT NULL AND owner <=> _their").select("key")
    heirs = rest.join(orphan, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("_heir"), F.lit(True).alias("_new"))
    counts = store(touched.filter("n_docs > 0").join(heirs, "key", "left").select(
        "key", "n_docs", F.when(F.col("_new"), F.col("_heir")).otherwise(F.col("owner")).alias("owner")), "line-counts")
    empty = touched.filter("n_docs = 0").select("key", F.col("_less").alias("n_docs"), "owner")
    filters = store(_filters(_through_filters(state, empty, "remove")), "line-filters")
    return State(rest, counts, filters, state.shards)


def apply(docs: DataFrame, state: State) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines it keeps, plus ``n_lines`` (before) and ``n_dropped``.

    Columns of ``docs`` that are named like the two new ones are replaced.
    """
    shared = state.counts.filter("n_docs >= 2").select("key", "owner")
    drops = state.postings.join(shared, "key").filter("NOT (doc_id <=> owner)")
    drops = drops.groupBy(F.col("doc_id").alias("_drop_id")).agg(F.collect_set("key").alias("_drops"))
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct(F.lit(0), *rest).alias("_rest"))
    met = rows.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")), "left").select("_text", "_drops", "_rest")
    kept = met.mapInArrow(_without, T.StructType([met.schema["_text"], met.schema["_rest"], T.StructField("n_lines", T.LongType()),
                                                  T.StructField("n_dropped", T.LongType())]))
    return kept.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_rest.{c}").alias(c) for c in docs.columns if c in rest or c == "text"],
                       "n_lines", "n_dropped")


def _without(batches):
    """Texts without the lines whose keys they drop: one look-up per line, however many keys go. A text that drops none is passed on."""
    for b in batches:
        texts, counts, dropped = [], [], []
        for text, drops in zip(b.column(0), b.column(1)):
            text, kept = text.as_py() or "", None
            if drops.is_valid:
                gone, all_lines = set(drops.as_py()), text.encode().split(b"\n")
                kept = [x for x in all_lines if hashlib.md5(x.strip(_SPACES).lower(), usedforsecurity=False).digest() not in gone]
                texts.append(b"\n".join(kept).decode())
                dropped.append(len(all_lines) - len(kept))
            else:
                texts.append(text)
                dropped.append(0)
            counts.append(text.count("\n") + 1)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                                         names=["_text", "_rest", "n_lines", "n_dropped"])


def build(docs: DataFrame, parts: int = 2) -> State:
    """The state of all of ``docs(doc_id, text)``, inserted in ``parts`` increments by a hash of the id.

    From the second increment on the filters are asked about every key.
    """
    held = store(postings(docs), "line-held")
    state = empty_state(held, shards_for(held.count()))
    for part in range(parts):
        state = insert(state, held.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part))
    return state


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that a smaller document holds, plus ``n_lines`` and ``n_dropped``."""
    return apply(docs, build(docs))
