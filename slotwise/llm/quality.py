"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame expressions only.

Words are ``[^\\x20\\x09-\\x0D]+``. Their unigrams and bigrams are hashed to ``BUCKETS`` buckets. One pass over all
documents counts the buckets of the raw corpus and, in the same scan, of the trusted target: every training document
labelled quality 1 that does not set the threshold. Both are multinomials with additive smoothing; a document's score is
the sum of log(target / raw) over its n-grams, divided by their number. Every document with a score of at least
``threshold`` is kept unless the base rules failed; nothing is drawn or limited.

The threshold is set on the given corpus, as scores move with its size. It parts the scores of training documents that
the base rules pass: of quality 1, those with crc32(doc_id) mod 5 = 1, which are no target (a target document scores
higher than its like); of quality 0, all. Of the cuts that lose at most ``LOSS`` of the good ones it has the least sum of
the share of good ones lost and of junk kept, and lies in the middle of the gap; the scores are ordered and summed by range
in many tasks. Without such documents of both classes only the base rules decide.

The table of log ratios is one literal array of ``BUCKETS`` doubles, rounded to four decimals. Every text is scored once;
counts and scores are stored without texts, so the threshold costs no second pass. The ids of the target are stored too, so
Spark knows their size: few are broadcast and texts stay where they are, many are joined by a shuffle of texts.

Repeated words: texts whose windows of three words have distinct hashes hold none. In the others the hash of each window is
packed with its place into one long; after sorting, equal
neighbours are the windows that may be repeated. Places take as few bits as the text needs, so fewer of the hash remain;
the words of these windows are therefore compared, and the places of the equal ones cover the repeated words: exact.

Cases: a null text has no words; texts without n-grams have score 0; without target documents every score is 0 and only
the base rules decide; repeated rows are judged alike; labels that repeat count once; a null doc_id is no target; an
empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import SPACES, finished, held_out, store

BUCKETS = 1 << 16
SMOOTHING = 1.0
LOSS = 0.02
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
_GAP = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, _GAP)).otherwise(F.array().cast("array<string>"))


def _grams(words: Column) -> Column:
    """Buckets of the unigrams and bigrams of ``words``, two for each word but the last."""
    low = F.lit(BUCKETS - 1).cast("long")  # BUCKETS is a power of two
    one = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(low))
    two = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
                      lambda w, i: F.xxhash64(w, F.get(words, i + 1)).bitwiseAND(low))
    return F.concat(one, two)


def _marks(labels: DataFrame) -> DataFrame:
    """``(doc_id, quality)``: each labelled id once."""
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))


def _apart(doc_id: Column) -> Column:
    """True for the training documents that are no target: their scores set the threshold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1


def target_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(_target)``: ids of the training documents labelled quality 1 that do not set the threshold."""
    good = _marks(labels).filter("quality = 1").filter(~held_out(F.col("doc_id")) & ~_apart(F.col("doc_id")))
    return good.select(F.col("doc_id").alias("_target"))


def threshold_ids(labels: DataFrame) -> DataFrame:
    """``(_id, _good)``: the training documents whose scores set the threshold."""
    marks = _marks(labels).filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_good"))
    return marks.filter((F.col("_good") == 0) | (F.col("_good") == 1) & _apart(F.col("_id")))


def cut(scores: list[tuple[float, int]]) -> float:
    """The threshold that parts ``(score, good)`` as described above."""
    scores = sorted(scores)
    n_good = sum(good for _, good in scores)
    n_junk = len(scores) - n_good
    if not n_good or not n_junk:
        return float("-inf")
    best, at, lost, dropped = 1.0, float("-inf"), 0, 0
    for (low, good), (high, _) in zip(scores, scores[1:]):
        lost, dropped = lost + good, dropped + 1 - good
        share = lost / n_good + 1 - dropped / n_junk
        if low < high and lost <= LOSS * n_good and share < best:
            best, at = share, (low + high) / 2 if low < (low + high) / 2 else high
    return at


def best_cut(rows: DataFrame) -> float:
    """``cut`` of ``rows(score, good)`` in many tasks: sums up to each score, by ranges of scores."""
    counts = rows.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("junk"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = store(counts.repartitionByRange(n, "score").withColumn("_range", F.spark_partition_id()), "scores")
    ranges = counts.groupBy("_range").agg(F.min("score").alias("_from"), F.sum("good").alias("_good"), F.sum("junk").alias("_junk"))
    ranges = sorted(ranges.collect())  # one for each partition
    n_good, n_junk = sum(r["_good"] for r in ranges), sum(r["_junk"] for r in ranges)
    if not n_good or not n_junk:
        return float("-inf")
    before, good, junk = [], 0, 0
    for r, after in zip(ranges, [*ranges[1:], None]):
        before.append((r["_range"], good, junk, after and after["_from"]))
        good, junk = good + r["_good"], junk + r["_junk"]
    before = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _lost long, _dropped long, _next double"))
    own = Window.partitionBy("_range").orderBy("score")
    rows = counts.join(before, "_range").select(
        F.col("score").alias("low"), F.coalesce(F.lead("score").over(own), "_next").alias("high"),
        (F.col("_lost") + F.sum("good").over(own)).alias("lost"), (F.col("_dropped") + F.sum("junk").over(own)).alias("dropped"))
    rows = rows.filter(F.col("high").isNotNull() & (F.col("lost") <= F.lit(LOSS) * n_good))
    rows = rows.withColumn("share", F.col("lost") / n_good + 1 - F.col("dropped") / n_junk).filter("share < 1")
    best = rows.agg(F.min(F.struct("share", "low", "high")).alias("best")).first()["best"]
    if best is None:
        return float("-inf")
    middle = (best["low"] + best["high"]) / 2
    return middle if best["low"] < middle else best["high"]


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``(ratios)``: log(target / raw) of every bucket, in order."""
    ids = store(target_ids(docs, labels), "targets")
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_target"), "left")
    grams = marked.select(word_list(F.col("text")).alias("_words"), F.col("_target").isNotNull().cast("long").alias("_good"))
    grams = grams.select(F.explode(_grams(F.col("_words"))).alias("bucket"), "_good")
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_good").alias("good"))
    every = docs.sparkSession.range(BUCKETS).join(counts, F.col("id") == F.col("bucket"), "left").select(
        "id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    listed = every.agg(F.sort_array(F.collect_list(F.struct("id", "raw", "good"))).alias("b"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    share = lambda count, total: (count + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * BUCKETS))
    ratio = F.transform("b", lambda x: F.log(share(x["good"], F.col("good")) / share(x["raw"], F.col("raw"))))
    return listed.select(F.when(F.col("good") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("ratios"))


def _windows(words: Column) -> Column:
    """Hashes of the windows of three words. ``words`` is a plain column."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                       lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, _words, ...)`` with the base counts of every row of ``docs(doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("_text")).withColumn("_words", word_list(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    rows = rows.withColumn("_windows", _windows(F.col("_words")))
    bits = F.ceil(F.log2(F.size("_words") + 1)).cast("int")
    packed = F.sort_array(F.transform("_windows", lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))
    packed = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), packed).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "_words", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"), packed.alias("_packed"), bits.alias("_bits"))
    high = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    at = F.col("_packed")
    maybe = F.filter(at, lambda x, i: (high(x) == high(F.get(at, i + 1))) | (high(x) == high(F.get(at, i - 1))))
    maybe = F.transform(maybe, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1))
    window = lambda p: F.concat_ws(" ", F.slice("_words", (p + 1).cast("int"), F.lit(3)))
    rows = rows.withColumn("_maybe", F.sort_array(F.transform(maybe, lambda p: F.struct(window(p).alias("w"), p.alias("p")))))
    near = F.col("_maybe")
    again = F.filter(near, lambda x, i: (x["w"] == F.get(near, i + 1)["w"]) | (x["w"] == F.get(near, i - 1)["w"]))
    places = F.sort_array(F.transform(again, lambda x: x["p"]))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("_places", places)
    place = F.col("_places")
    covered = F.aggregate(place, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda acc, p: F.struct(
        (acc["n"] + F.least(p - acc["last"], F.lit(3).cast("long"))).alias("n"), p.alias("last")), lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", covered).drop("_lines", "_packed", "_bits", "_maybe", "_places")


def scored(docs: DataFrame, ratios: Column) -> DataFrame:
    """Base counts, ``base_failed`` and ``score`` of every row of ``docs(doc_id, text)``."""
    rows = features(docs)
    # the literal is named once, as every plan description holds each copy of it
    total = F.aggregate(_grams(F.col("_words")), F.lit(0.0), lambda a, x: a + F.get(ratios, x.cast("int")))
    rows = rows.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).drop("_words")
    # a Generate is a barrier: a filter on the result stays above it, instead of repeating the expressions for each word
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def fitted_threshold(rows: DataFrame, labels: DataFrame) -> float:
    """The threshold from all of ``rows(doc_id, score, base_failed)`` that ``threshold_ids`` names."""
    chosen = rows.select("doc_id", "score", "base_failed").join(threshold_ids(labels), F.col("doc_id") == F.col("_id"))
    chosen = chosen.groupBy("doc_id", F.col("_good").alias("good")).agg(F.min("score").alias("score"), F.max("base_failed").alias("failed"))
    return best_cut(chosen.filter("NOT failed").select("score", F.col("good").cast("long").alias("good")))


@finished("quality")
def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """Base counts, ``score``, ``base_failed`` and ``kept`` of every row of ``docs(doc_id, text)``."""
    # BUCKETS numbers come to the driver and go back as one literal that is folded to an array once
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in log_ratios(docs, labels).first()["ratios"])), ",").cast("array<double>")
    rows = store(scored(docs, ratios), "scored")
    if threshold is None:
        threshold = fitted_threshold(rows, labels)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
