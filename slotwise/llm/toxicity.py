"""Toxicity by a linear-chain conditional random field over the words of a text.

Tokens are runs of letters, compared in lower case; each is tagged O or T (toxic). Features of a token are the word and
its beginnings of 4 and 5 letters. Labelled tokens come from document labels: the lexicon holds the features that toxic
training documents have significantly more often (copies counted once), and tokens with one of them are T in toxic
documents; all other tokens, and every token of a clean document, are O. Weights: one per lexicon feature, one for all
tokens, a 2 x 2 transition table and two start weights, fitted by gradient ascent on the regularised likelihood of
stretches of ``STRETCH`` tokens.

Scoring runs the forward-backward recursions over the whole token sequence. Words without lexicon feature share one
transfer matrix, so a stretch of k of them is its k-th power, from a table or by repeated squaring; the marginals P(T) are thus exact at
every word with one, in time linear in the text. The document score is a logistic function, fitted on the
training sample, of the greatest marginal and of the expected number of toxic tokens. Offending spans are the character
offsets of tokens with a marginal of at least 0.5.

Training sample: of rows whose crc32(doc_id) mod 5 is not 0, at most ``PER_CLASS`` documents of either label, those
with the least hashes of their ids among documents of at most ``SAMPLE_CHARS`` characters; it is collected (a documented
bound of 2 x PER_CLASS x SAMPLE_CHARS characters), of an id's rows the one with the least text. The field is fitted on all
stretches of the sample that hold a lexicon word, ``SEQUENCES`` at a time, and on as many others, at least 1,000, those
with the least hashes of their words (without a lexicon word they differ in length alone). Labels, lang, source and doc_id are never inputs of a score.

Cases: null and empty texts score like a text without toxic words; rows without label are scored all the same; a label
that repeats counts as toxic if any copy does; without both classes in the sample every score is 0; null doc_id is held
out; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import held_out, small_batches

PER_CLASS = 1500
SAMPLE_CHARS = 20_000
LEXICON = 2000
STRETCH = 48
SEQUENCES = 6000
STEPS = 120
POWERS = 256
REMEMBERED = 200_000
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """CRF weights (O is state 0, T is state 1) and the document-level logistic function."""

    feature: dict[str, float] = field(default_factory=dict)
    other: float = -8.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    score: tuple[float, float, float] = (-40.0, 0.0, 0.0)  # bias, greatest marginal, expected number

    def table(self) -> list[tuple[float, float, float, float]]:
        """Powers 0 to ``POWERS`` of the transfer matrix of other words, each scaled to a greatest entry of 1."""
        one = np.exp(self.move + np.array([0.0, self.other]))
        out, m = [], np.eye(2)
        for _ in range(POWERS + 1):
            out.append(tuple(m.ravel().tolist()))
            m = m @ one
            m /= m.max()
        return out


class Weights(dict):
    """Factor of a word's T state, 0 for words without lexicon feature; remembers a bounded number of words."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        own = [x for f in features(word) if (x := self.model.feature.get(f)) is not None]
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = float(np.exp(self.model.other + sum(own))) if own else 0.0
        return value


class Tagger:
    def __init__(self, model: Model) -> None:
        self.model, self.powers = model, model.table()
        self.weights = Weights(model)
        (self.a, self.b), (self.c, self.d) = np.exp(model.move).tolist()
        self.start, self.other = np.exp(model.start).tolist(), float(np.exp(model.other))
        self.far: dict[int, tuple[float, float, float, float]] = {}

    def power(self, gap: int) -> tuple[float, float, float, float]:
        """The transfer matrix of ``gap`` other words, scaled: from the table, or beyond it by repeated squaring."""
        if gap <= POWERS:
            return self.powers[gap]
        found = self.far.get(gap)
        if found is None:
            (p, q, r, s), (a, b, c, d) = self.power(gap // 2), self.power(gap - gap // 2)
            found = (p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d)
            top = max(found)
            if len(self.far) >= REMEMBERED:
                self.far.clear()
            self.far[gap] = found = tuple(x / top for x in found)
        return found

    def marginals(self, at: list[int], weight: list[float], n: int) -> list[float]:
        """P(T) at the ascending token places ``at``, whose words weigh ``weight``, among ``n`` tokens."""
        forward = []
        u, v, last = self.start[0], self.start[1], -1
        for i, w in zip(at, weight):
            gap = i - last - 1
            if last < 0 and gap:
                v *= self.other
                gap -= 1
            if gap:
                p, q, r, s = self.power(gap)
                u, v = u * p + v * r, u * q + v * s
            if i:
                u, v = u * self.a + v * self.c, u * self.b + v * self.d
            v *= w
            total = u + v
            u, v, last = u / total, v / total, i
            forward.append((u, v))
        x, y, ahead, out = 1.0, 1.0, n, []
        for k in range(len(at) - 1, -1, -1):
            gap = ahead - at[k] - 1
            if gap:
                p, q, r, s = self.power(gap)
                x, y = x * p + y * q, x * r + y * s
            u, v = forward[k]
            out.append(v * y / (u * x + v * y))
            w = weight[k]
            x, y = self.a * x + self.b * w * y, self.c * x + self.d * w * y
            total = x + y
            x, y, ahead = x / total, y / total, at[k]
        return out[::-1]

    def tag(self, text: str) -> tuple[list[int], list[float], int]:
        """Places of lexicon words among the tokens, their marginals, the number of tokens."""
        factors = list(map(self.weights.__getitem__, map(str.lower, TOKEN.findall(text))))
        at = [i for i, w in enumerate(factors) if w]
        return at, self.marginals(at, [factors[i] for i in at], len(factors)), len(factors)

    def document(self, marginals: list[float]) -> float:
        bias, greatest, expected = self.model.score
        z = bias + greatest * max(marginals, default=0.0) + expected * np.log1p(sum(marginals))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def spans(self, text: str, at: list[int], marginals: list[float]) -> list[tuple[int, int]]:
        """Character offsets (start, end) of tokens more likely toxic than not."""
        toxic = {i for i, p in zip(at, marginals) if p >= 0.5}
        return [m.span() for i, m in enumerate(TOKEN.finditer(text)) if i in toxic] if toxic else []


def features(word: str) -> list[str]:
    return [f"{word}$", *[word[:n] for n in (4, 5) if len(word) > n]]


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(text, toxic)`` of the training sample described above."""
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    usable = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    ids = usable.select("doc_id").distinct().join(marks, F.col("doc_id") == F.col("_id"))
    least = lambda rows: rows.select("_id", "toxic").orderBy(F.xxhash64("_id"), "_id").limit(per_class)
    ids = least(ids.filter("toxic > 0")).unionByName(least(ids.filter("toxic <= 0")))
    # at most 2 * per_class ids: broadcast, so that texts are not shuffled; of an id's rows the least text counts
    chosen = usable.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    return chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _lexicon(texts: list[list[str]], toxic: np.ndarray, size: int) -> list[str]:
    """Features that toxic documents hold significantly more often: z of the difference of rates at least 5.

    A feature counts once for each pair of neighbouring words that it has in a class, so copies of a document count once.
    """
    around: dict[str, tuple[set, set]] = {}
    for words, mark in zip(texts, toxic):
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            for f in features(w):
                around.setdefault(f, (set(), set()))[int(mark)].add(hash((before, after)))
    n0, n1 = max(int((toxic == 0).sum()), 1), max(int((toxic == 1).sum()), 1)
    scored = []
    for f, (clean, bad) in around.items():
        a, b = min(len(clean), n0), min(len(bad), n1)
        p = (a + b + 1) / (n0 + n1 + 2)
        z = (b / n1 - a / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
        if b >= 5 and z >= 5 and len(bad) / n1 >= 8 * (len(clean) + 0.5) / n0:
            scored.append((-z, f))
    return [f for _, f in sorted(scored)[:size]]


def _fit_crf(x: np.ndarray, y: np.ndarray, live: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of features (index 0: all tokens), transitions and starts.

    ``x`` is (sequences, places, features of a token), padded with index ``n_features + 1``; ``y`` and ``live`` are
    (sequences, places).
    """
    places, pad = x.shape[1], n_features + 1
    own, move, start = np.zeros(n_features + 2), np.zeros((2, 2)), np.zeros(2)
    own[0] = -4.0
    grads = [np.zeros_like(p) for p in (own, move, start)]
    squares = [np.zeros_like(p) for p in (own, move, start)]

    def spread(weights: np.ndarray) -> np.ndarray:
        """Per feature the sum of its tokens' weights."""
        out = np.bincount(x.ravel(), weights=np.repeat(weights.ravel(), x.shape[2]), minlength=n_features + 2)
        out[0], out[pad] = weights.sum(), 0
        return out

    gold_own = spread((live & (y == 1)).astype(float))
    pair = live[:, 1:]
    gold_move = np.array([[(pair & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    gold_start = np.array([(y[:, 0] == 0).sum(), (y[:, 0] == 1).sum()], dtype=float)

    def expected(x: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of toxic places, and expected transitions and starts, under the weights so far."""
        factor = np.exp(own[0] + own[x].sum(axis=2))
        step_to = np.exp(move)
        alpha = np.empty((places, len(x), 2))
        alpha[0] = np.exp(start)
        alpha[0, :, 1] *= factor[:, 0]
        alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
        for t in range(1, places):
            a = alpha[t - 1] @ step_to
            a[:, 1] *= factor[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[t] = np.where(live[:, t, None], a, alpha[t - 1])
        beta, toxic, e_move = np.ones((len(x), 2)), np.zeros_like(factor), np.zeros((2, 2))
        for t in range(places - 1, -1, -1):
            on = live[:, t]
            post = alpha[t] * beta
            post /= post.sum(axis=1, keepdims=True)
            toxic[on, t] = post[on, 1]
            if t:
                right = beta.copy()
                right[:, 1] *= factor[:, t]
                joint = alpha[t - 1][:, :, None] * step_to[None] * right[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                e_move += joint[on].sum(axis=0)
                b = right @ step_to.T
                b /= b.sum(axis=1, keepdims=True)
                beta = np.where(on[:, None], b, beta)
        return toxic, e_move, post.sum(axis=0)

    for step in range(1, STEPS + 1):
        parts = [expected(x[at:at + SEQUENCES], live[at:at + SEQUENCES]) for at in range(0, len(x), SEQUENCES)]  # bounds what is held
        toxic, e_move, e_start = np.concatenate([p[0] for p in parts]), sum(p[1] for p in parts), sum(p[2] for p in parts)
        params, golds, expects = (own, move, start), (gold_own, gold_move, gold_start), (spread(toxic), e_move, e_start)
        for p, g, e, m, v in zip(params, golds, expects, grads, squares):  # Adam, with an L2 penalty
            slope = (g - e) / len(x) - 1e-4 * p
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        own[pad] = 0.0
    return own[:pad], move, start


def _logistic(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighing alike."""
    x = np.column_stack([np.ones(len(y)), features])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1e-1] * features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        w += np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, slope)
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = training_sample(docs, labels, per_class).toArrow().to_pylist()
    sample.sort(key=lambda r: (r["doc_id"], r["text"]))
    toxic = np.array([int(r["toxic"] > 0) for r in sample])
    if len(set(toxic.tolist())) < 2:
        return Model()
    texts = [[t.lower() for t in TOKEN.findall(r["text"])] for r in sample]
    lexicon = _lexicon(texts, toxic, LEXICON)
    if not lexicon:
        return Model()
    index = {f: i + 1 for i, f in enumerate(lexicon)}
    pad, known = len(lexicon) + 1, {}
    for w in {w for words in texts for w in words}:
        own = [index[f] for f in features(w) if f in index]
        if own:
            known[w] = own + [pad] * (3 - len(own))
    busy, idle = [], []
    for words, mark in zip(texts, toxic):
        for at in range(0, len(words), STRETCH):
            part = words[at:at + STRETCH]
            (busy if any(w in known for w in part) else idle).append((part, mark))
    idle.sort(key=lambda r: xxhash.xxh3_64_intdigest(" ".join(r[0]).encode()))  # which of them are taken must not hang on ids
    rows = busy + idle[:max(len(busy), 1000)]
    x, live = np.full((len(rows), STRETCH, 3), pad, dtype=np.int64), np.zeros((len(rows), STRETCH), dtype=bool)
    y = np.zeros((len(rows), STRETCH), dtype=np.int64)
    for i, (part, mark) in enumerate(rows):
        live[i, :len(part)] = True
        for j, w in enumerate(part):
            if w in known:
                x[i, j], y[i, j] = known[w], mark
    own, move, start = _fit_crf(x, y, live, len(lexicon))
    model = Model({f: float(own[i]) for f, i in index.items()}, float(own[0]), move, start)
    tagger = Tagger(model)
    marks = [tagger.tag(r["text"])[1] for r in sample]
    w = _logistic(np.array([[max(m, default=0.0), np.log1p(sum(m))] for m in marks]), toxic)
    model.score = tuple(float(v) for v in w)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, spans)`` of every row; spans are (start, end) character offsets of offending tokens."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON features
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        tagger = Tagger(shared.value)
        for b in batches:
            scores, spans = [], []
            for value in b.column(1):
                text = value.as_py() or ""
                at, marginals, _ = tagger.tag(text)
                scores.append(tagger.document(marginals))
                spans.append([{"start": s, "end": e} for s, e in tagger.spans(text, at, marginals)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)],
                                             names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` of every row of ``docs(doc_id, text)``."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
