"""Language identification with a string kernel.

The kernel counts the distinct character n-grams, n = 1 to 3, that two texts share (blended spectrum, presence), divided
by the geometric mean of their numbers of distinct n-grams. n-grams are hashed to ``DIM`` indices.

Training: at most ``PER_LANGUAGE`` labelled rows of each language (least hashes of the id) form the sample, whose
presence vectors come to the driver as bit maps of ``DIM / 8`` bytes each, however long the texts are. At most
``LANDMARKS`` of them, an equal share of each language, are the Nystrom landmarks: with K_mm = V S V', the features of a
text are its kernel values to the landmarks times V S^(-1/2), and ridge regression in that space is fitted once per
language, one against the rest. Bit maps are opened ``BLOCK`` at a time, and the model keeps those of its landmarks, so
the driver never holds the sample's dense vectors; tasks open the landmarks once.

Scoring: kernel values of a batch are one matrix product of its presence vectors with the landmarks', and its scores one
more with the fitted map. The languages' scores are turned into shares by a softmax; the greatest share is the score.

A text that is null or has no letter is ``und`` with score 0. Cases: null doc_id is held out; ties between languages go
to the first in code-point order; with no labelled row every text is ``und``; an empty table gives an empty table;
repeated rows are scored alike; columns other than doc_id, text and lang are ignored or passed through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import held_out, small_batches

DIM = 1 << 15
PER_LANGUAGE = 300
LANDMARKS = 128
RIDGE = 1e-2
SHARPNESS = 6.0
BLOCK = 64
ORDERS = (1, 2, 3)
STRETCH = 1 << 20
UND = "und"
#: Odd multipliers of the n-gram hash (Fibonacci hashing), one per order.
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - (DIM.bit_length() - 1))


def presence(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted indices of the distinct hashed n-grams of a text; ``seen`` is a zeroed scratch array of ``DIM`` bytes."""
    for at in range(0, len(text), STRETCH):
        part = text[at:at + STRETCH + max(ORDERS) - 1].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        gram = code
        for n, mix in zip(ORDERS, _MIX):
            if n > 1:
                if len(code) < n:
                    break
                gram = (gram[:-1] << np.uint64(21)) | code[n - 1:]
            seen[((gram + np.uint64(n)) * mix) >> _SHIFT] = 1
    found = np.flatnonzero(seen)
    seen[found] = 0
    return found


def _opened(bits: list[bytes]) -> np.ndarray:
    """(rows, DIM) float32: the presence vectors of bit maps, each divided by the root of its size."""
    x = np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8)).reshape(len(bits), DIM).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


@dataclass
class Model:
    languages: list[str]
    bits: list[bytes]  # bit maps of the landmarks
    map: np.ndarray    # (m, languages) float32: Nystrom projection times ridge weights

    @cached_property
    def landmarks(self) -> np.ndarray:
        """(DIM, m) float32, opened where it is first used."""
        return np.ascontiguousarray(_opened(self.bits).T)

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Regression scores of a batch of presence vectors."""
        x = np.zeros((len(found), DIM), dtype=np.float32)
        for row, own in zip(x, found):
            row[own] = 1.0 / np.sqrt(max(len(own), 1))
        return (x @ self.landmarks) @ self.map


def _bitmaps(rows: DataFrame) -> DataFrame:
    def run(batches):
        seen = np.zeros(DIM, dtype=np.uint8)
        for b in batches:
            bits = []
            for text in b.column(1):
                x = np.zeros(DIM, dtype=np.uint8)
                x[presence(text.as_py() or "", seen)] = 1
                bits.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], names=["lang", "bits"])
    return rows.select("lang", "text").mapInArrow(run, "lang string, bits binary")


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` labelled rows of each language, those with the least hashes of their ids; of an id's rows the least text.

    The chosen ids, ``per_language`` times the number of languages, are broadcast, so that texts are not shuffled.
    """
    learnt = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = learnt.select("doc_id", "lang").distinct().withColumn("_draw", F.xxhash64("doc_id"))
    first = ids.withColumn("_nth", F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "doc_id"))).filter(
        F.col("_nth") <= per_language).select(F.col("doc_id").alias("_doc_id"), F.col("lang").alias("_lang")).distinct()
    chosen = learnt.join(F.broadcast(first), (F.col("doc_id") == F.col("_doc_id")) & (F.col("lang") == F.col("_lang")))
    return chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; only rows whose crc32(doc_id) mod 5 is not 0 and whose lang is not null count."""
    small_batches(docs.sparkSession)
    table = _bitmaps(training_sample(docs, per_language)).toArrow()
    names = np.array(table.column("lang").to_pylist(), dtype=object)
    bits = table.column("bits").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i], bits[i]))
    names, bits = names[order], [bits[i] for i in order]
    languages = sorted(set(names))
    if not languages:
        return Model([], [], np.zeros((0, 0), np.float32))
    share = max(1, landmarks // len(languages))
    picked = np.concatenate([(own := np.flatnonzero(names == lang))[np.linspace(0, len(own) - 1, min(share, len(own))).astype(int)]
                             for lang in languages])
    chosen = [bits[i] for i in picked]
    z = _opened(chosen)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    held = values > 1e-6 * values.max()
    project = vectors[:, held] / np.sqrt(values[held])
    kernel = np.concatenate([_opened(bits[at:at + BLOCK]) @ z.T for at in range(0, len(bits), BLOCK)])
    features = kernel.astype(np.float64) @ project
    goal = np.where(names[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
    weight = np.sqrt(len(names) / (len(languages) * np.array([(names == n).sum() for n in names])))[:, None]  # languages count alike
    f, g = features * weight, goal * weight
    beta = np.linalg.solve(f.T @ f + ridge * len(names) * np.eye(f.shape[1]) / len(languages), f.T @ g)
    return Model(languages, chosen, (project @ beta).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), batch: int = 64) -> DataFrame:
    """The columns ``keep`` of ``docs`` plus ``lang_pred`` and ``score``; only ``text`` is an input of the prediction."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: a bit map for each landmark
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))
    schema = ", ".join([*[f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "lang_pred string", "score double"])

    def run(batches):
        m, seen = shared.value, np.zeros(DIM, dtype=np.uint8)
        for b in batches:
            texts = b.column(len(keep))
            langs, scores = [UND] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts), batch):
                own, found = [], []
                for i in range(at, min(at + batch, len(texts))):
                    text = texts[i].as_py()
                    if m.languages and text and any(map(str.isalpha, text)):
                        own.append(i)
                        found.append(presence(text, seen))
                if own:
                    s = m.scores(found).astype(np.float64) * SHARPNESS
                    e = np.exp(s - s.max(axis=1, keepdims=True))
                    best = e.argmax(axis=1)
                    for i, k, p in zip(own, best, e.max(axis=1) / e.sum(axis=1)):
                        langs[i], scores[i] = m.languages[k], float(p)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             names=[*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``, all columns, ``lang`` as predicted; ``und`` is rejected."""
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    judged = predict(whole, fit(docs), keep=("row",)).filter((F.col("lang_pred") != UND) & (F.col("score") >= min_score))
    return judged.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs(doc_id, text, lang)``, learnt from those same rows."""
    return predict(docs, fit(docs)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
