"""Plain Python versions of the operators, over rows in memory."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def jaccard_components(rows):
    """{doc_id: (set size, component)} of (doc_id, text) rows with distinct ids."""
    sets, union = {i: shingle_set(t) for i, t in rows}, Union()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
                union.join(a, b)
    return {i: (len(sets[i]), union.find(i)) for i in ids}


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def dedupe_lines(rows):
    """{doc_id: (lines, dropped, kept text)} of (doc_id, text) rows with distinct ids."""
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 10:
                holders[line_key(line)].add(i)
    out = {}
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(line_key(x), ())) < 2 or min(holders[line_key(x)]) == i]
        out[i] = (len(all_lines), len(all_lines) - len(kept), "\n".join(kept))
    return out


def quality_counts(text):
    """words, characters in words, symbols, repeated lines, repeated words"""
    text = text or ""
    w = WORD.findall(text)
    times = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if times[tuple(w[k:k + 3])] >= 2 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def runs(words, exponent=4, length=6):
    """[(start, length, period)] of all runs, by start, then period: each period's equal stretches, least period per stretch."""
    least, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - s >= max(length, exponent * p):
                least.setdefault((s, i + p), p)
            i += 1
    return sorted(((s, e - s, p) for (s, e), p in least.items()), key=lambda r: (r[0], r[2]))


def periodic_words(doc_id, text):
    """The words of a document after the contract's repetition."""
    import zlib

    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(WORD.findall(text or ""))
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def run_row(words):
    found = runs(words)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k=10):
    """{(item_id, rank): (doc_id, score)} over rows of (doc_id, text) and (item_id, text)."""
    import math

    terms = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c, sum(c.values())) for i, c in terms if c]
    count, total = len(terms), sum(n for _, _, n in terms)
    df = collections.Counter(t for _, c, _ in terms for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = {}
    for item, own in asked.items():
        scored = []
        for doc, c, n in terms:
            m = 10 + 90 * n * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out |= {(item, r + 1): (x[3], -x[0]) for r, x in enumerate(scored[:k])}
    return out
