"""N-gram Jaccard join with a token-group matrix.

A document's set holds 64-bit hashes of its distinct five-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased;
fewer words: the whole sequence as one; no words: empty set). Two documents link when ``5 * |A & B| >= 4 * |A | B|``.

1. Documents of equal sets form a class; classes stand for their members from here on.
2. Linked sets of sizes n and m share at least L = min(l(n), l(m)) of their least ``n - ceil(4n/5) + l(n)`` hashes, with
   l(n) = 1 + n // 10. Counting, for every class, how many hashes of this prefix some other class's prefix holds too
   sets aside all classes that can link with none: most of a corpus. The rest are counted once more with all their
   hashes, of which ceil(4n/5) must be held elsewhere. Hashes are dealt to tasks in packed arrays; one that many
   documents of a task hold is settled there and sent on twice, so frequent lines cost no skew.
3. Groups of similar sets: classes with the same min-hash under one of ``PERMUTATIONS`` orders and like sketches join one
   leader; connected, these pairs give the groups. Pairs with a leader that are links, by exact comparison, also give
   first components, so that most links are known before any group is opened.
4. Token-group matrix: per token the groups whose union holds it. A set links with another group only if at least
   ceil(4n/5) of its tokens are in other groups' unions, which sets aside nearly all. For the rest, the tokens held by
   fewest groups (enough of them that one must be shared) name the candidate groups.
5. Every group is opened for its own members, and the candidate groups for the sets that named them, in chunks of about
   ``CHUNK`` members. A set whose overlap with a chunk's token union is below ceil(4n/5) is sent away; the others are
   compared exactly with the members that are not in their component yet. A task puts out a link only where it joins
   two components, so never the pairs of a group.

All bounds are safe, so the components are those of all links.

Cases: documents without words and rows with null doc_id link with nothing; their component is their own doc_id; rows
that repeat a doc_id are one node of the graph; equal sets always link; an empty table gives an empty table; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import finished, small_batches, store
from slotwise.llm.components import connected_components

WIDTH = 5
PERMUTATIONS = 6
SKETCH = 24
ALIKE = 8           # of SKETCH minima that a class and a leader must share to be put in one group
FLUSH = 1_000_000   # hashes that a map task gathers before it deals them
BUCKET = 1_000_000  # hashes that a bucket expects
OFTEN = 8           # holders of one hash in a flush, above which it is settled in the map task
CHUNK = 1000
_PIECE = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(12).integers(1, 1 << 63, SKETCH + PERMUTATIONS, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", _ODD_INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size; each run begins with the last words of the one before."""
    if len(data) <= _PIECE:
        yield data.split()
        return
    carry, at = [], 0
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        own = carry + data[at:end].split()
        if len(own) >= WIDTH or end >= len(data):
            yield own
            carry = own[-(WIDTH - 1):]
        else:
            carry = own
        at = end


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: a polynomial over bytes, so any stretch comes from prefix sums."""
    found = []
    for words in _pieces(text.encode("utf-8", "surrogatepass").lower()):
        if not words or (found and len(words) < WIDTH):
            continue
        line = np.frombuffer(b" ".join(words), dtype=np.uint8)
        up, down = _power_table(len(line) + 1)
        total = np.zeros(len(line) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[line] * up[:len(line)], out=total[1:])
        gaps = np.flatnonzero(line == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))
        k = max(1, len(words) - WIDTH + 1)
        s, e = starts[:k], ends[len(words) - k:]
        found.append(_mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def least_overlap(n):
    """ceil(4n / 5)"""
    return (4 * n + 4) // 5


def _spare(n):
    return 1 + n // 10


def _prefix(n: int) -> int:
    return min(n, n - least_overlap(n) + _spare(n))


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield shingles(value.as_py() or "")


class _Dealer:
    """Gathers the tokens of a map task's sets, each with an owner and a group, and deals them to buckets in packed arrays."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held = buckets, 0
        self.sets: list[tuple[np.ndarray, int, int]] = []

    def add(self, tokens: np.ndarray, owner: int, group: int) -> None:
        self.sets.append((tokens, owner, group))
        self.held += len(tokens)

    def flush(self) -> Iterator[dict]:
        if not self.held:
            return
        token = np.concatenate([x[0] for x in self.sets])
        owner, first, place = np.unique(np.array([x[1] for x in self.sets], dtype=np.int64), return_index=True, return_inverse=True)
        group = np.array([x[2] for x in self.sets], dtype=np.int64)[first]
        who = np.repeat(place.astype(np.int32), [len(x[0]) for x in self.sets])
        self.sets, self.held = [], 0
        order = np.lexsort((who, token))
        token, who = token[order], who[order]
        again = np.zeros(len(token), dtype=bool)  # copies of one owner count once
        again[1:] = (token[1:] == token[:-1]) & (who[1:] == who[:-1])
        token, who = token[~again], who[~again]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(start, len(token)))
        low, high = np.minimum.reduceat(group[who], start), np.maximum.reduceat(group[who], start)
        often = (size > OFTEN) & (low != high)  # held by two groups: shared for certain
        if often.any():
            settled = np.repeat(often, size)
            some, times = np.unique(who[settled], return_counts=True)
            yield {"bucket": -1, "owners": owner[some].tobytes(), "groups": times.astype(np.int64).tobytes()}
            # two holders of different groups stand for all in the bucket; their own counts are not wanted again
            t = token[start[often]]
            token = np.concatenate((token[~settled], t, t))
            who = np.concatenate((who[~settled], np.arange(2 * len(t), dtype=np.int32) + np.int32(len(owner))))
            owner = np.concatenate((owner, np.full(2 * len(t), NOBODY)))
            group = np.concatenate((group, low[often], high[often]))
        at = ((token * _ODD) >> np.uint64(33)).astype(np.int64) % self.buckets
        order = np.lexsort((who, at))
        token, who, at = token[order], who[order], at[order]
        cuts = np.searchsorted(at, np.arange(self.buckets + 1))
        for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if j > i:
                runs = np.flatnonzero(np.concatenate(([True], who[i + 1:j] != who[i:j - 1])))
                names = who[i:j][runs]
                yield {"bucket": k, "tokens": token[i:j].tobytes(), "owners": owner[names].tobytes(), "groups": group[names].tobytes(),
                       "counts": np.diff(np.append(runs, j - i)).astype(np.uint32).tobytes()}


NOBODY = np.iinfo(np.int64).min
_PACKED = "bucket int, tokens binary, owners binary, groups binary, counts binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("tokens", "owners", "groups", "counts")])
_COUNTED = "a long, b long, s1 long, s2 long, owners binary, counts binary"
_COUNTED_ARROW = pa.schema([(c, pa.int64()) for c in ("a", "b", "s1", "s2")] + [("owners", pa.binary()), ("counts", pa.binary())])
_ROWS_ARROW = pa.schema([(c, pa.int64()) for c in ("a", "b", "s1", "s2")])


def _counts_of(owner: np.ndarray, times: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row (part, owners, counts) for each part that the owners are dealt to next."""
    at = (owner.view(np.uint64) * _ODD >> np.uint64(33)).astype(np.int64) % parts
    rows = [{"a": k, "owners": owner[own].tobytes(), "counts": times[own].tobytes()} for k in range(parts) if (own := at == k).any()]
    return pa.RecordBatch.from_pylist(rows, schema=_COUNTED_ARROW)


def _count(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Owners, and how many of their tokens in this bucket another group holds too."""
    token = np.frombuffer(b"".join(p["tokens"] for p in parts), dtype=np.uint64)
    counts = np.frombuffer(b"".join(p["counts"] for p in parts), dtype=np.uint32)
    owner = np.repeat(np.frombuffer(b"".join(p["owners"] for p in parts), dtype=np.int64), counts)
    group = np.repeat(np.frombuffer(b"".join(p["groups"] for p in parts), dtype=np.int64), counts)
    order = np.argsort(token, kind="stable")
    token, owner, group = token[order], owner[order], group[order]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    shared = np.minimum.reduceat(group, start) != np.maximum.reduceat(group, start)
    hit = np.repeat(shared, np.diff(np.append(start, len(token)))) & (owner != NOBODY)
    token, owner = token[hit], owner[hit]
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), dtype=bool)  # an owner's copies in two map tasks count once
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    who, times = np.unique(owner[new], return_counts=True)
    return who, times.astype(np.int64)


def _counted(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed counts (a: part, owners, counts) of each bucket, and the rows (a, b, s1, s2) that came along in bucket -2."""
    met = packed.repartition(F.when(F.col("bucket") < 0, F.xxhash64("owners")).otherwise(F.xxhash64("bucket"))).sortWithinPartitions("bucket")
    parts = 1 + buckets // 16

    def run(batches):
        at, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] == -1:
                    yield _counts_of(*(np.frombuffer(row[c], dtype=np.int64) for c in ("owners", "groups")), parts)
                elif row["bucket"] == -2:
                    for own in pa.ipc.open_stream(row["owners"]):
                        yield pa.RecordBatch.from_arrays([*own.columns, *[pa.nulls(len(own), pa.binary())] * 2], schema=_COUNTED_ARROW)
                else:
                    if row["bucket"] != at and held:
                        yield _counts_of(*_count(held), parts)
                        held = []
                    at = row["bucket"]
                    held.append(row)
        if held:
            yield _counts_of(*_count(held), parts)

    return met.mapInArrow(run, _COUNTED)


def _totals(counted: DataFrame) -> DataFrame:
    """``(owner, shared)``: the buckets' counts added up."""
    met = counted.filter("owners IS NOT NULL").select("a", "owners", "counts").repartition("a").sortWithinPartitions("a")

    def added(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        owner, place = np.unique(np.frombuffer(b"".join(x for x, _ in held), dtype=np.int64), return_inverse=True)
        total = np.bincount(place, weights=np.frombuffer(b"".join(x for _, x in held), dtype=np.int64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(total)], names=["owner", "shared"])

    def run(batches):
        at, held = None, []
        for b in batches:
            for part, owners, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
                if part != at and held:
                    yield added(held)
                    held = []
                at = part
                held.append((owners, counts))
        if held:
            yield added(held)

    return met.mapInArrow(run, "owner long, shared long")


def _packed(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([rows], schema=_PACKED_ARROW)


def _buckets(tokens: float | None) -> int:
    return max(1, int((tokens or 0) // BUCKET) + 1)


def scan_sets(docs: DataFrame) -> DataFrame:
    """One pass over ``docs(doc_id, text)``: rows (doc_id, size, signature) and, by ``s1`` of the signature, shared prefix hashes.

    The number of buckets comes from the corpus' characters; it only sizes tasks.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    buckets = _buckets((chars or 0) / 6 * 0.3)

    def run(batches):
        dealer = _Dealer(buckets)
        for b in batches:
            sizes, first, second = [], [], []
            for t in (shingles(x.as_py() or "") for x in b.column(1)):
                s1, s2 = _signature(t)
                sizes.append(len(t))
                first.append(s1)
                second.append(s2)
                if len(t):
                    dealer.add(t[:_prefix(len(t))], s1, s1)
            own = pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                                              pa.array(second, pa.int64())], schema=_ROWS_ARROW)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ROWS_ARROW) as writer:
                writer.write_batch(own)
            yield _packed({"bucket": -2, "owners": sink.getvalue().to_pybytes()})
            if dealer.held >= FLUSH:
                yield from map(_packed, dealer.flush())
        yield from map(_packed, dealer.flush())

    return _counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PACKED), buckets)


def _sets(docs: DataFrame) -> DataFrame:
    """``(cid, n, tokens)`` of ``docs(cid, text)``."""
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            own = [shingles(x.as_py() or "") for x in b.column(1)]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return docs.mapInArrow(run, "cid long, n long, tokens array<long>")


def _minima(sets: DataFrame) -> DataFrame:
    """``(cid, n, minima, sketch)``: min-hashes that name groups, and a sketch that tells how alike two sets are."""
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("minima", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            rows = []
            for cid, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _tokens(b.column(2))):
                low = np.array([_mixed(t.view(np.uint64) ^ seed).min() for seed in _SEEDS])
                rows.append({"cid": cid, "n": n, "minima": low[:PERMUTATIONS].view(np.int64),
                             "sketch": (low[PERMUTATIONS:] >> np.uint64(33)).astype(np.int32)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sets.select("cid", "n", "tokens").mapInArrow(run, "cid long, n long, minima array<long>, sketch array<int>")


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    yield from np.split(flat, np.cumsum(ends)[:-1]) if len(ends) else ()


def _alike_pairs(sets: DataFrame) -> DataFrame:
    """``(cid, lead, fits)``: classes and the leader of each of their min-hash groups whose sketch is like theirs; links need fitting sizes."""
    own = store(_minima(sets), "minima").select("cid", "n", "sketch", F.posexplode("minima").alias("part", "low"))
    order = F.xxhash64("cid", "part")
    leader = own.groupBy(F.col("part").alias("_part"), F.col("low").alias("_low")).agg(
        F.min(F.struct(order.alias("draw"), "cid", "n", "sketch")).alias("_lead"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    met = own.join(leader, (F.col("part") == F.col("_part")) & (F.col("low") == F.col("_low")))
    alike = F.size(F.filter(F.arrays_zip(F.col("sketch").alias("x"), F.col("_lead.sketch").alias("y")), lambda z: z["x"] == z["y"]))
    fits = 5 * F.least("n", "_lead.n") >= 4 * F.greatest("n", "_lead.n")
    return met.filter((F.col("cid") != F.col("_lead.cid")) & (alike >= ALIKE)).select(
        "cid", F.col("_lead.cid").alias("lead"), fits.alias("fits")).distinct()


def _star_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links ``(a, b)`` among ``pairs(cid, lead, fits)``."""
    both = pairs.filter("fits").select("cid", "lead").join(sets.select("cid", "tokens"), "cid").join(
        sets.select(F.col("cid").alias("lead"), F.col("tokens").alias("others")), "lead").select("cid", "lead", "tokens", "others")

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(_tokens(b.column(2)), _tokens(b.column(3))):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                good.append(5 * inter >= 4 * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _matrix_counts(grouped: DataFrame) -> DataFrame:
    """``(owner, shared)``: tokens of each class of ``grouped(cid, n, tokens, group)`` that another group's union holds."""
    buckets = _buckets(grouped.agg(F.sum("n")).first()[0])

    def run(batches):
        dealer = _Dealer(buckets)
        for b in batches:
            for cid, group, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _tokens(b.column(2))):
                dealer.add(t.view(np.uint64), cid, group)
            if dealer.held >= FLUSH:
                yield from map(_packed, dealer.flush())
        yield from map(_packed, dealer.flush())

    return _totals(_counted(grouped.select("cid", "group", "tokens").mapInArrow(run, _PACKED), buckets))


def _covered(grouped: DataFrame) -> DataFrame:
    """The rows of ``grouped`` at least ceil(4n/5) of whose tokens are in other groups' unions: no other can link outside its group."""
    counts = _matrix_counts(grouped)
    return grouped.join(counts, F.col("cid") == F.col("owner")).filter(F.col("shared") >= F.floor((4 * F.col("n") + 4) / 5)).select(*grouped.columns)


class _Chunk:
    """Some members of a group: the chunk's row of the token-group matrix, with the holders of each token, and components."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]) -> None:
        self.cid = [r[0] for r in rows]
        self.label = np.array([r[1] for r in rows])
        self.other: dict[int, int] = {}  # labels of components that came in with queries
        self.sizes = np.array([len(r[2]) for r in rows])
        self.tokens = [r[2] for r in rows]
        flat, who = np.concatenate(self.tokens), np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.union, start = np.unique(flat[order], return_index=True)
        self.who, self.start = who[order], np.append(start, len(flat))

    def links(self, cid: int, component: int, tokens: np.ndarray) -> Iterator[dict]:
        """Links of a set that join its component with components of members."""
        mine = self.other.get(component, component)
        if (self.label == mine).all():
            return
        place = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        place = place[self.union[place] == tokens]
        if len(place) < least_overlap(len(tokens)):
            return
        holders = np.concatenate([self.who[self.start[p]:self.start[p + 1]] for p in place])
        inter = np.bincount(holders, minlength=len(self.cid))
        linked = np.flatnonzero((5 * inter >= 4 * (self.sizes + len(tokens) - inter)) & (self.label != mine))
        for label, first in zip(*np.unique(self.label[linked], return_index=True)):
            yield {"a": cid, "b": self.cid[linked[first]]}
            self.label[self.label == label] = mine
            self.other = {k: mine if v == label else v for k, v in self.other.items()} | {int(label): mine}

    def own_links(self) -> Iterator[dict]:
        for i, cid in enumerate(self.cid):
            yield from self.links(cid, int(self.label[i]), self.tokens[i])


def _open(members: DataFrame, queries: DataFrame) -> DataFrame:
    """Links ``(a, b)`` among ``members(group, chunk, cid, component, tokens)`` of a chunk, and of ``queries`` (same columns) with them."""
    rows = members.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)))
    met = rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "kind").select(
        "group", "chunk", "kind", "cid", "component", "tokens")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, held, chunk = None, [], None
        for b in batches:
            out = []
            for g, c, kind, cid, component, t in zip(*(b.column(i).to_pylist() for i in range(5)), _tokens(b.column(5))):
                if (g, c) != at:
                    if chunk is None and len(held) > 1:
                        out += _Chunk(held).own_links()
                    at, held, chunk = (g, c), [], None
                if kind == 0:
                    held.append((cid, component, t.copy()))
                elif held:
                    if chunk is None:
                        chunk = _Chunk(held)
                        out += chunk.own_links()
                    out += chunk.links(cid, component, t)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if chunk is None and len(held) > 1:
            yield pa.RecordBatch.from_pylist(list(_Chunk(held).own_links()), schema=schema)

    return met.mapInArrow(run, "a long, b long")


def _named_groups(grouped: DataFrame) -> DataFrame | None:
    """``(cid, group)``: other groups whose token unions a set's rarest tokens name; None when no set is covered by others."""
    queries = store(_covered(grouped.select("cid", "n", "tokens", "group")), "queries")
    if queries.isEmpty():
        return None
    wanted = queries.select("cid", "n", "group", F.explode("tokens").alias("token"))
    matrix = store(grouped.select("group", F.explode("tokens").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
                   .distinct(), "matrix")
    spread = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("held_by"))
    rare = wanted.join(spread, "token").groupBy("cid", "n", "group").agg(F.sort_array(F.collect_list(F.struct("held_by", "token"))).alias("own"))
    rare = rare.select("cid", "group", F.explode(F.slice("own", F.lit(1), (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1).cast("int"))).alias("t"))
    rare = rare.filter("t.held_by > 1").select("cid", F.col("group").alias("mine"), F.col("t.token").alias("token"))
    return store(rare.join(matrix, "token").filter("group <> mine").select("cid", "group").distinct(), "named")


def _group_links(sets: DataFrame, groups: DataFrame, components: DataFrame) -> DataFrame:
    """Links that join components: within groups, and with the groups that the token-group matrix names."""
    grouped = store(sets.join(groups.select(F.col("node").alias("cid"), F.col("component").alias("_group")), "cid", "left")
                    .join(components.select(F.col("node").alias("cid"), "component"), "cid", "left")
                    .select("cid", "n", "tokens", F.coalesce("_group", "cid").alias("group"), F.coalesce("component", "cid").alias("component")), "grouped")
    chunks = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("held"), F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    named = _named_groups(grouped)
    opened = chunks.filter("held > 1")
    if named is not None:
        opened = chunks.join(named.select(F.col("group").alias("_named")).distinct(), F.col("group") == F.col("_named"), "left").filter(
            "held > 1 OR _named IS NOT NULL")
    opened = store(opened.select(F.col("group").alias("_group"), "chunks"), "opened")
    rows = grouped.join(opened, F.col("group") == F.col("_group")).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    cell = ["group", "chunk", "cid", "component", "tokens"]
    # within a group a set meets its own chunk as a member and the chunks after it as a query
    asked = (rows.filter("chunk < chunks - 1").drop("_group").withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)))
             .select(*cell))
    if named is not None:
        apart = (named.join(opened, F.col("group") == F.col("_group")).select(
            F.col("cid").alias("_cid"), F.col("group").alias("_to"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
        asked = asked.unionByName(grouped.join(apart, F.col("cid") == F.col("_cid")).select(
            F.col("_to").alias("group"), "chunk", "cid", "component", "tokens"))
    return _open(rows.select(*cell), asked)


@finished("near-duplicates")
def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs(doc_id, text)``; stored, intermediates are deleted."""
    spark = docs.sparkSession
    small_batches(spark)
    scanned = store(scan_sets(docs), "set-scan")
    rows = scanned.filter("s1 IS NOT NULL").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "s1", "s2")
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"))
    # a set's partner has at least ceil(4n/5) hashes, so they share at least l(ceil(4n/5)) of the prefix
    need = 1 + F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10)
    left = store(classes.join(_totals(scanned), F.col("s1") == F.col("owner")).filter(F.col("shared") >= need).select("cid", "n"), "left")
    # Spark's own run-time Bloom filter (bounded in size) on the ids keeps other texts out of the shuffle
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "10MB")
    texts = docs.select("doc_id", "text").join(left.filter("n > 0").select("cid"), F.col("doc_id") == F.col("cid")).select("cid", "text")
    # rows that repeat a doc_id may have other sets: all of them belong to its node
    sets = store(_sets(texts).filter("n > 0").withColumn("group", F.col("cid")), "sets")
    sets = store(_covered(sets).drop("group"), "covered")
    pairs = store(_alike_pairs(sets), "alike")
    links = store(_star_links(pairs, sets), "star-links")
    found = store(_group_links(sets, connected_components(pairs.select(F.col("cid").alias("a"), F.col("lead").alias("b"))), connected_components(links)), "group-links")
    names = classes.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "cid")
    own = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2"))
    # a doc_id whose rows have several sets joins the classes of all of them
    sign = F.struct("s1", "s2")
    several = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sign).alias("_low"), F.max(sign).alias("_high")).filter(
        "_low <> _high").select(F.col("doc_id").alias("_many"))
    several = store(rows.filter("n > 0").join(several, F.col("doc_id") == F.col("_many"), "left_semi").join(names, own)
                    .select(F.col("doc_id").alias("a"), F.col("cid").alias("b")).distinct(), "several")
    components = connected_components(links.unionByName(found).unionByName(several))
    named = rows.join(names, own, "left")
    node = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cid")).otherwise(F.col("doc_id"))
    out = named.withColumn("_at", node).join(components, F.col("_at") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "_at").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the least doc_id of each group of linked texts stays, once; rows with null doc_id stay.

    Rows of one doc_id with different texts are documents of their own here: a text goes only with a near copy of itself.
    """
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    known, text = rows.filter("doc_id IS NOT NULL"), F.xxhash64("text")
    several = known.select("doc_id", text.alias("_text")).groupBy("doc_id").agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
    several = store(several.filter("_low <> _high").select(F.col("doc_id").alias("_many")), "several-ids")
    known = known.withColumn("_node", F.col("doc_id"))
    if not several.isEmpty():
        known = known.join(several, F.col("doc_id") == F.col("_many"), "left").withColumn(
            "_node", F.when(F.col("_many").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))).drop("_many")
    groups = near_duplicates(known.select(F.col("_node").alias("doc_id"), "text")).select(F.col("doc_id").alias("_of"), "component_id").distinct()
    least = known.select("doc_id", "_node").distinct().join(groups, F.col("_node") == F.col("_of")).groupBy("component_id").agg(
        F.min(F.struct("doc_id", "_node")).alias("_least")).select(F.col("_least._node").alias("_root"))
    kept = known.join(least, F.col("_node") == F.col("_root"), "left_semi").groupBy("_node").agg(F.first("_row").alias("_row")).select("_row")
    return kept.unionByName(rows.filter("doc_id IS NULL").select("_row")).select("_row.*")
