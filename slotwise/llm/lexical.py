"""Ranked lexical search over a length-stratified index.

Documents with the same length normaliser ``m`` form a stratum, which is cut into blocks of at most ``BLOCK`` documents.
A block's postings stand by term and, within a term, by tf: ``(m, block, term, tf, docs)``, ``docs`` being places in the block's
list of documents. Neighbouring blocks of at most ``BLOCK`` documents together form a segment, the unit that is gathered in one
place. The part of a score that depends on ``(tf, m)``, the impact, is thus worked out once per tf of a
block, and the greatest tf of a term bounds what the term can add to any document of the block.

Building: one scan of the texts counts each document's terms and stores the counts, whose totals ``m`` needs; they are then dealt in
ranges of ``(m, hash)``, so a stratum that holds a third of all documents spans many tasks, and each task writes the blocks of its
range. The index covers every document and every term.

Searching: an item's bound in a block is the sum of its terms' weights times the bounds of the terms. Blocks are visited
in order of the bound: first ``SEEDS`` blocks per item, whose k-th best score is a threshold; then every other block whose
bound reaches the threshold (equal scores are told apart by doc_id, so equal bounds count). No document that could be
among the k best is left out. A segment's postings of the terms in question meet the visits to its blocks, where each
item adds them up block by block and hands on its k best documents of the segment at most.

Scores are 64-bit integers: ``weight * ((1000000000 * tf) div (1000 * tf + 8 * m))`` summed over an item's distinct terms,
with ``weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and ``m = 10 + (90 * n * N) div L``.

Cases: null texts have no terms; documents without terms are not indexed; items without terms, or whose terms are in no
document, have no rows; rows that repeat an item_id are one item with the terms of all; rows that repeat a doc_id are
documents of their own, and documents without an id count and rank first among equal scores; very long texts are read
whole; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import drop_stored, lower_ascii, store

#: Fixed value: a term is a longest stretch of ASCII letters, ASCII digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 4096
FLUSH = 250_000  # counted terms that a task hands on at once
PAIRS = 1_000_000  # postings that a task holds before it closes a block, beside those of one document
SEEDS = 8
#: UTF-8 bytes with A-Z lower-cased and what separates terms as blanks.
_FOLD = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256)).lower()
_INDEX = "segment long, m long, block long, term string, tf long, docs array<int>, doc_ids array<long>"


@dataclass(frozen=True)
class Index:
    """``postings(segment, m, block, term, tf, docs)`` and ``blocks(segment, m, block, doc_ids)``, with the number of documents and of terms."""

    postings: DataFrame
    blocks: DataFrame
    documents: int
    terms: int

    def drop(self) -> None:
        """Delete the index's files."""
        drop_stored(self.postings)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def _counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: the distinct terms of each row of ``docs(doc_id, text)`` with their counts; ``n`` terms in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, tfs, ends, n = 0, [], [], [0], []
            for i, text in enumerate(b.column(1), 1):
                counts = Counter((text.as_py() or "").encode().translate(_FOLD).split())
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                ends.append(len(terms))
                n.append(counts.total())
                if len(terms) >= FLUSH or i == len(b):
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
                             for x in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, i - at), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                    at, terms, tfs, ends, n = i, [], [], [0], []

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<string>, tfs array<int>")
    return store(rows.filter("n > 0"), "lexical-terms")


def _block_rows(rows: list[pa.RecordBatch], segment: int, m: int, block: int) -> Iterator[pa.RecordBatch]:
    """The index rows of a block whose documents are ``rows(m, doc_id, terms, tfs)``."""
    def batch(n: int, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(np.full(n, x)) for x in (segment, m, block)], *columns],
                                          names=["segment", "m", "block", "term", "tf", "docs", "doc_ids"])

    places, ids = pa.list_(pa.int32()), pa.list_(pa.int64())
    doc_ids = [d for r in rows for d in r.column(1).to_pylist()]
    yield batch(1, pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, places), pa.array([doc_ids], ids))
    coded = pa.concat_arrays([r.column(2).flatten() for r in rows]).dictionary_encode()
    term = coded.indices.to_numpy()
    tf = np.concatenate([r.column(3).flatten().to_numpy() for r in rows]).astype(np.int64)
    place = np.repeat(np.arange(len(doc_ids), dtype=np.int32), np.concatenate([pc.list_value_length(r.column(2)).to_numpy() for r in rows]))
    order = np.lexsort((place, tf, term))
    term, tf, place = term[order], tf[order], place[order]
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
    docs = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(term)].astype(np.int32)), pa.array(place))
    yield batch(len(starts), coded.dictionary.take(pa.array(term[starts])), pa.array(tf[starts]), docs, pa.nulls(len(starts), ids))


def build(docs: DataFrame, block: int = BLOCK) -> Index:
    """The index of all documents of ``docs(doc_id, text)`` that have a term."""
    counted = _counted(docs)
    total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    count, terms = int(total[0]), int(total[1])
    m = F.expr(f"10L + (90L * n * {count}L) div {max(terms, 1)}L")
    dealt = counted.select(m.alias("m"), "doc_id", "terms", "tfs", F.xxhash64("doc_id", "terms").alias("_deal"))
    dealt = dealt.repartitionByRange("m", "_deal").sortWithinPartitions("m").select("m", "doc_id", "terms", "tfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, segment, at, held = TaskContext.get().partitionId() << 32, 0, None, []
        docs = pairs = 0  # of the segment
        for b in batches:
            start = 0
            for i, (of, size) in enumerate(zip(b.column(0).to_pylist(), pc.list_value_length(b.column(2)).to_pylist())):
                full = docs >= block or pairs >= PAIRS
                if docs and (of != at or full):
                    if i > start:
                        held.append(b.slice(start, i - start))
                    start = i
                    if held:
                        yield from _block_rows(held, number + segment, at, number)
                        number, held, segment = number + 1, [], segment - 1  # a segment has the number of its first block
                    if full:
                        segment = docs = pairs = 0
                at = of
                docs += 1
                pairs += size
            held.append(b.slice(start))
        if held:
            yield from _block_rows(held, number + segment, at, number)

    rows = store(dealt.mapInArrow(run, _INDEX), "lexical-index")
    drop_stored(counted)
    return Index(rows.filter("term IS NOT NULL").drop("doc_ids"), rows.filter("term IS NULL").select("segment", "m", "block", "doc_ids"), count, terms)


def impact(tf: Column | str, m: Column | str) -> Column:
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 8L * {m})")


def _visit(visits: DataFrame, wanted: DataFrame, hits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``(item, doc_id, score)``: of each ``(item, segment, block, least)`` the block's documents with ``least`` or more, ``k`` per segment at most."""
    asked = visits.groupBy("segment", "item").agg(F.min("least").alias("least"), F.collect_set("block").alias("blocks")).join(wanted, "item")
    asked = asked.select("segment", "item", "least", "blocks", "terms", "weights")
    here = hits.select("segment", "block", "m", "term", "tf", "docs", F.lit(None).cast("array<long>").alias("doc_ids")).unionByName(
        blocks.select("segment", "block", "m", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("tf"),
                      F.lit(None).cast("array<int>").alias("docs"), "doc_ids"))
    here = here.join(visits.select("block").distinct(), "block", "left_semi")

    def score(items: pa.Table, rows: pa.Table) -> pa.Table:
        ids: dict[int, list] = {}
        lists: dict[int, dict[str, list]] = {}  # block -> term -> (documents, impact) of each tf
        docs = rows.column("docs").combine_chunks()
        places, ends = docs.values.to_numpy(), docs.offsets.to_numpy()
        for at, (block, m, term, tf, doc_ids) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("block", "m", "term", "tf", "doc_ids")))):
            if term is None:
                ids[block] = doc_ids
            else:
                lists.setdefault(block, {}).setdefault(term, []).append((places[ends[at]:ends[at + 1]], 1000000000 * tf // (1000 * tf + 8 * m)))
        found: list[tuple] = []
        for item, least, visited, terms, weights in zip(*(items.column(c).to_pylist() for c in ("item", "least", "blocks", "terms", "weights"))):
            best: list[tuple] = []
            for block in visited:
                own, total = lists.get(block, {}), np.zeros(len(ids[block]), np.int64)
                for term, weight in zip(terms, weights):
                    for where, add in own.get(term, ()):
                        total[where] += weight * add
                top = np.flatnonzero(total >= least)
                if len(top) > k:
                    top = top[total[top] >= np.partition(total[top], -k)[-k]]
                best += [(-s, d is not None, d or 0, d) for s, d in zip(total[top].tolist(), [ids[block][i] for i in top])]
            found += [(item, d, -s) for s, _, _, d in sorted(best, key=lambda x: x[:3])[:k]]
        item, doc_id, score = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(x, pa.int64()) for x in (item, doc_id, score)], names=["item", "doc_id", "score"])

    return asked.groupBy("segment").cogroup(here.groupBy("segment")).applyInArrow(score, "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10, seeds: int = SEEDS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item of ``items(item_id, text)``, score above 0.

    The result, k rows an item, is stored, and what led to it is deleted; the index stays for further searches.
    """
    items = items.select(F.col("item_id").cast("long"), F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    # a struct is never null, so an item without an id is joined like any other
    items = store(items.select(F.xxhash64(F.struct("item_id")).alias("item"), "item_id", "term"), "lexical-items")
    hits = store(index.postings.join(items.select("term").distinct(), "term", "left_semi"), "lexical-hits")
    df = hits.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.documents + 2)) / (F.lit(2.0) * F.col("df") + 1.0)))
    weighed = store(items.join(df, "term").select("item", "term", weight.cast("long").alias("weight")).filter("weight > 0"), "lexical-weights")
    pairs = weighed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("pairs"))
    wanted = pairs.select("item", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights"))
    most = hits.groupBy("segment", "block", "m", "term").agg(F.max("tf").alias("tf")).select("segment", "block", "term", impact("tf", "m").alias("most"))
    bounds = store(most.join(weighed, "term").groupBy("item", "segment", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "lexical-bounds")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= seeds).select("item", "segment", "block", F.lit(1).cast("long").alias("least"))
    seeded = store(_visit(first, wanted, hits, index.blocks, k), "lexical-seeds")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    kth = seeded.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).groupBy("item").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(1).alias("least"))
    rest = bounds.join(first.select("item", "block"), ["item", "block"], "left_anti").join(kth, "item", "left")
    rest = rest.withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).filter("bound >= least").select("item", "segment", "block", "least")
    found = seeded.unionByName(_visit(rest, wanted, hits, index.blocks, k))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = items.select("item", "item_id").distinct()
    result = store(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "lexical-result")
    drop_stored(items, hits, weighed, bounds, seeded)
    return result
