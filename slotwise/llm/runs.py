"""Periodic runs of words by online dyadic square catching.

Words are appended in stretches of any number, one included; the runs do not depend on the stretches. For each power of
two ``b`` the completed blocks ``[j b, (j + 1) b)`` have catchers. The catcher of a block waits for the words that repeat
the block ``p`` words later, ``b <= p < 2 b``: a square of that period whose equal part is at least ``2 b`` long holds a whole
block, so each such square is caught, and each window of ``b`` appended words meets just one catcher, that of the block
before its own. Below three repeats the equal part is shorter, so blocks two and three back are asked instead.

A window and a block are compared by 64-bit hashes, built from those of half the length. Of catches of one
period in neighbouring blocks only the first counts, as they are one stretch. A catch goes on as a suffix comparison: its words must
repeat at distance ``p`` long enough for the least exponent. Prefix hashes decide that at once where the words are there;
else it waits for appended words. What passes is compared word by word to both sides, which joins the caught squares into a
maximal run; a run that reaches the last word grows with later words. Catches inside a run whose period divides theirs are the
run's own multiples and are left out; the same stretch under several periods keeps the least. Equal words have equal hashes,
so nothing is missed but by a collision of two 64-bit hashes of neighbouring catches; nothing false is ever reported.

Work is O(n log n) in vector steps, and memory O(n): a level keeps the hashes of its last few blocks.

Cases: null and empty texts have no words and no runs; runs of equal extent count once, with their least period; runs of
different periods may overlap; repeated rows are worked on again; very long texts are appended in stretches; an empty
table gives an empty table; other columns are passed through or ignored as the caller selects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_EXPONENT = 4
MIN_LENGTH = 6
STRETCH = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEEP = 6  # blocks of hashes that a level keeps
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class SquareCatcher:
    """Finds the runs of at least ``exponent`` periods and ``length`` words in the numbers appended to it."""

    def __init__(self, exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> None:
        if exponent < 2:
            raise ValueError("a run holds a square, so its exponent is at least 2")
        self.exponent, self.length, self.n = exponent, length, 0
        self.t = np.zeros(256, np.int64)  # the words
        self.sums = np.zeros(257, np.uint64)  # prefix sums of word hash * base ** place
        self.powers = np.ones(257, np.uint64)
        self.level: list[np.ndarray] = []  # hashes of the last windows of 1, 2, 4, ... words
        self.closed: list[tuple[int, int, int]] = []  # (start, end, period) of runs that a word has ended
        self.growing: list[tuple[int, int, int]] = []  # of runs that reach the last word
        self.waiting = np.zeros((3, 0), np.int64)  # block, window and size of catches whose comparison needs more words

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        if before == self.n:
            return
        hashes = _mix(words.astype(np.uint64) + _BASE)
        self._extend(before, words, hashes)
        growing, self.growing = self.growing, []
        for s, e, p in growing:
            self._keep(s, e + self._equal(e - p, e), p)
        waiting, self.waiting = self.waiting, np.zeros((3, 0), np.int64)
        if waiting.size:
            self._compare(*waiting)
        fresh, k, size = hashes, 0, 1
        while size <= self.n:
            if k == len(self.level):
                self.level.append(np.zeros(0, np.uint64))
            new = max(before - size + 1, 0)  # the first window that these words complete
            w = np.concatenate([self.level[k], fresh]) if len(self.level[k]) else fresh
            base = new - len(self.level[k])
            for back in (1,) if self.exponent >= 3 else (1, 2, 3) if k == 0 else (2, 3):
                self._catch(w, base, new, k, size, back)
            higher = max(before - 2 * size + 1, 0)
            if self.n >= 2 * size:
                fresh = _mix(w[higher - base:self.n - 2 * size + 1 - base] * _BASE + w[higher + size - base:self.n - size + 1 - base])
            self.level[k] = w[-min(len(w), _KEEP * size):]
            k, size = k + 1, 2 * size

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of the runs among the words so far, by start, then period."""
        least: dict[tuple[int, int], int] = {}
        for s, e, p in self.closed + self.growing:
            if p < least.get((s, e), p + 1):
                least[s, e] = p
        return sorted(((s, e - s, p) for (s, e), p in least.items()), key=lambda r: (r[0], r[2]))

    def _extend(self, before: int, words: np.ndarray, hashes: np.ndarray) -> None:
        if self.n > len(self.t):
            room = max(self.n, 2 * len(self.t))
            for name, more in (("t", 0), ("sums", 1), ("powers", 1)):
                old = getattr(self, name)
                grown = np.zeros(room + more, old.dtype)
                grown[:before + more] = old[:before + more]
                setattr(self, name, grown)
        self.t[before:self.n] = words
        with np.errstate(over="ignore"):
            self.powers[before + 1:self.n + 1] = _BASE
            self.powers[before:self.n + 1] = np.cumprod(self.powers[before:self.n + 1])
            self.sums[before + 1:self.n + 1] = hashes * self.powers[before:self.n]
            self.sums[before:self.n + 1] = np.cumsum(self.sums[before:self.n + 1])

    def _catch(self, w: np.ndarray, base: int, new: int, k: int, size: int, back: int) -> None:
        """Meet each new window with the catcher ``back`` blocks before its own."""
        first, last = max(new, back * size), self.n - size
        if first > last:
            return
        at = np.arange(first, last + 1)
        hit = np.nonzero(w[first - base:last + 1 - base] == w[(((at >> k) - back) << k) - base])[0]
        if not len(hit):
            return
        window = at[hit]
        block = ((window >> k) - back) << k
        earlier = np.nonzero(block >= size)[0]
        known = np.zeros(len(window), bool)
        known[earlier] = w[window[earlier] - size - base] == w[block[earlier] - size - base]
        block, window = block[~known], window[~known]
        if len(window):
            self._compare(block, window, np.full(len(window), size))

    def _compare(self, block: np.ndarray, window: np.ndarray, size: np.ndarray) -> None:
        """Go on with catches: those whose words repeat long enough become runs, those short of words wait."""
        period, keep = window - block, np.ones(len(window), bool)
        order = np.argsort(window, kind="stable")
        block, window, size, period = block[order], window[order], size[order], period[order]
        least = int(size.min())
        for s, e, p in self.closed + self.growing:
            if e - s >= 2 * least:
                lo, hi = np.searchsorted(window, [s, e])
                own = slice(lo, hi)
                keep[own] &= ~((period[own] % p == 0) & (block[own] >= s) & (window[own] + size[own] <= e) & (period[own] > p))
        need = (self.exponent - 1) * period - size
        there = np.minimum(need, self.n - window)
        with np.errstate(over="ignore"):
            left = (self.sums[block + there] - self.sums[block]) * self.powers[period]
            keep &= left == self.sums[window + there] - self.sums[window]
        short = keep & (there < need)
        self.waiting = np.concatenate([self.waiting, [block[short], window[short], size[short]]], axis=1)
        for a, i in zip(block[keep & ~short].tolist(), window[keep & ~short].tolist()):
            p, ahead = i - a, self._equal(a, i)
            self._keep(a - self._equal_before(a, i), i + ahead, p)

    def _keep(self, s: int, e: int, p: int) -> None:
        if e - s >= max(self.length, self.exponent * p):
            (self.growing if e == self.n else self.closed).append((s, e, p))
        elif e == self.n:  # not long enough yet
            self.waiting = np.concatenate([self.waiting, [[s], [s + p], [1]]], axis=1)

    def _equal(self, x: int, y: int) -> int:
        """How many words from ``x`` on equal those from ``y`` on, ``x < y``."""
        far, step = 0, 16
        while y + far < self.n:
            step = min(step, self.n - y - far)
            other = self.t[x + far:x + far + step] != self.t[y + far:y + far + step]
            if other.any():
                return far + int(other.argmax())
            far, step = far + step, 4 * step
        return far

    def _equal_before(self, x: int, y: int) -> int:
        """How many words before ``x`` equal those before ``y``, ``x < y``."""
        far, step = 0, 16
        while far < x:
            step = min(step, x - far)
            other = self.t[x - far - step:x - far][::-1] != self.t[y - far - step:y - far][::-1]
            if other.any():
                return far + int(other.argmax())
            far, step = far + step, 4 * step
        return far


def stretches(data: bytes) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in lists of about ``STRETCH`` words at most."""
    at, size = 0, 4 * STRETCH
    while at < len(data):
        cut = _BLANK.search(data, at + size) if len(data) > at + size else None
        part = data[at:cut.start()] if cut else data[at:]
        at += len(part) + 1
        yield part.split()


def runs_of(text: str, exponent: int, length: int) -> tuple[list[tuple[int, int, int]], str]:
    """The runs of a text, and its words without the repeats: what a run holds after its first period goes."""
    catcher, number, ids = SquareCatcher(exponent, length), {}, []
    for words in stretches(text.encode()):
        part = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
        ids.append(part)
        catcher.append(part)
    found = catcher.runs()
    all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    kept = np.ones(len(all_ids), bool)
    for s, n, p in found:
        kept[s + p:s + n] = False
    words = list(number)
    return found, b" ".join([words[i] for i in all_ids[kept].tolist()]).decode()


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def find_runs(df: DataFrame, exponent: int = MIN_EXPONENT, length: int = MIN_LENGTH) -> DataFrame:
    """``df`` with ``runs`` (structs of start, length and period in words, by start, then period), ``best`` and ``collapsed``.

    A run is a maximal stretch of words with a least period, ``exponent`` times the period and ``length`` words long at
    least. ``best`` has the greatest length / period, then the least start, then the least period. ``collapsed`` is the text with
    the words of each run after its first period left out, joined by one space. The three names replace columns of ``df``.
    """
    names = [c for c in df.columns if c not in ("runs", "best", "collapsed")]
    passed = [n for n in names if n != "text"]
    schema = T.StructType([*[df.schema[n] for n in passed], T.StructField("runs", T.ArrayType(_RUN)), T.StructField("best", _RUN),
                           T.StructField("collapsed", T.StringType())])
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_row = lambda r: dict(zip(("start", "length", "period"), r))
        for b in batches:
            runs, best, collapsed = [], [], []
            for text in b.column(b.num_columns - 1):
                found, rest = runs_of(text.as_py() or "", exponent, length)
                top = None
                for r in found:  # in order, so the first of equals stays
                    if top is None or r[1] * top[2] > top[1] * r[2]:
                        top = r
                runs.append([as_row(r) for r in found])
                best.append(top and as_row(top))
                collapsed.append(rest)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(runs, pa.list_(one)), pa.array(best, one), pa.array(collapsed, pa.string())],
                                             names=[*passed, "runs", "best", "collapsed"])

    return df.select(*passed, F.col("text")).mapInArrow(run, schema)
