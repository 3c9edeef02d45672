"""Mixing sources to target weights by systematic sampling.

Sizes are word counts. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the corpus size;
a source's target stops at ``max_copies`` times its own size and the excess is shared again by weight. That fixed
point is ``target = min(max_copies * size, level * weight)`` for one common ``level``, found by prefix sums over the
sources in order of ``max_copies * size / weight``: a table with one row per source, the only unsplit step.

Every document of a source expects ``target / source size`` copies. Within a source the documents are put in order of
size, their expected copies are prefix-summed, one offset in [0, 1) drawn from a hash of (seed, source) is added, and a
document is emitted once per integer boundary that its stretch crosses. As neighbours have nearly equal sizes, the
words taken differ from the target by about one document. A hot source is cut into ranges (``plans.ranking.positions``).

Cases: null text has size 0; null source is a source of its own; a source or corpus of size 0 has target 0 and no
copies; equal sizes are ordered by doc_id, wholly equal rows by nothing (either may be taken); an empty table gives an
empty table; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import WORD
from slotwise.plans.ranking import positions

SEED = 20240601
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """``(source, source_size, target)``, one row per source of ``sizes(source, size)``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    per = per.withColumn("_rank", rank).withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * max_copies
    per = per.withColumn("_cap", cap).withColumn("_full", cap / F.col("_weight"))
    by_level = Window.orderBy("_full", "_rank")
    whole = Window.orderBy("_full", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.sum("source_size").over(whole) - before) / rest)
    # the candidate levels rise while sources are capped and fall afterwards: the greatest is the fixed point
    level = F.max("_level").over(whole)
    return per.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_weight"))).select(
        "source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per row of ``docs(doc_id, text, source)``."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    ranked = positions(sizes, ["source"], [F.col("size"), F.col("doc_id")], name="_position")
    targets = source_targets(ranked.select("source", "size"), weights, max_copies)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit(""))).cast("binary")), 1, 12),
                  16, 10).cast("double") / float(1 << 48)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(each * k + draw)
    out = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "copies", (upto(F.col("_position")) - upto(F.col("_position") - 1)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows of one doc_id, source and size share their copies in text order."""
    taken = mix(docs, weights, max_copies, seed)
    key = lambda size: F.struct("doc_id", "source", size)  # noqa: E731  compares nulls as equal, as a join of columns would not
    taken = taken.select(key(F.col("size").alias("_size")).alias("_mixed"), "copies")
    taken = taken.withColumn("_mixed_nth", F.row_number().over(Window.partitionBy("_mixed").orderBy("copies"))).filter("copies > 0")
    rows = docs.select(key(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size")).alias("_key"),
                       F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_text"))).drop("_text")
    picked = rows.join(taken, (F.col("_key") == F.col("_mixed")) & (F.col("_nth") - F.col("_mixed_nth") == 0))
    return picked.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
