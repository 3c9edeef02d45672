"""Byte-level BPE encoding and decoding with a public rank file.

Two tiers resolve each pre-token (a match of the splitting pattern):

1. a minimal perfect hash over the vocabulary: a pre-token that is a token gets its id from one slot, compared with the
   bytes stored there;
2. otherwise its bytes form a doubly linked list and a heap holds the mergeable neighbours by (rank, place). The least
   is merged until none is left; stale heap entries are skipped. A merge's rank also comes from the perfect hash.

A bounded memo per task keeps the ids of pre-tokens seen before, as natural text repeats them; another keeps the ranks
of neighbours.

Texts of ASCII and Latin letters, the frequent case, are split by an equivalent pattern of the standard library, which
is about three times as fast; any other character sends the whole text to the given pattern. Long texts are worked
through in stretches of pre-tokens, so memory does not grow with them beyond the text itself.

Single bytes must be tokens, as in every byte-level vocabulary. The vocabulary has a fixed size (0.8 MB file) and is broadcast; nothing is shuffled.

Cases: null and empty texts have no tokens; ties cannot occur, as ranks differ; repeated rows are encoded again; an
empty table gives an empty table; the other columns of the table are passed through or ignored as the caller selects.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from slotwise.llm.common import small_batches

MEMO = 250_000  # pre-tokens in each of the memo's two generations
PAIRS = 500_000
STRETCH = 200_000
#: Letters that the fast pattern knows: a-z, A-Z and the letters of U+00C0 to U+024F.
_LATIN = "a-zA-ZÀ-ÖØ-öø-ɏ"
_OUTSIDE = re.compile(rf"[^\x09-\x0D\x20-\x7E{_LATIN}]")
#: Fixed value: the splitting pattern that the fast pattern is equal to on texts without ``_OUTSIDE`` characters.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = re.compile(rf" ?[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys in n slots, one displacement per first-level bucket.

    Buckets of several keys get, largest first, the least seed that sends all their keys to free slots; single keys
    get a free slot directly, stored as a negative displacement.
    """

    def __init__(self, keys: dict[bytes, int]) -> None:
        n = len(keys)
        self.n, self.move = n, array("q", [0]) * max(n, 1)
        self.key: list[bytes | None] = [None] * max(n, 1)
        self.value = array("q", [0]) * max(n, 1)
        buckets: dict[int, list[bytes]] = {}
        for k in keys:
            buckets.setdefault(xxhash.xxh3_64_intdigest(k) % n, []).append(k)
        for at, own in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
            if len(own) == 1:
                break
            seed = 1
            while True:
                slots = [xxhash.xxh3_64_intdigest(k, seed) % n for k in own]
                if len(set(slots)) == len(own) and all(self.key[s] is None for s in slots):
                    break
                seed += 1
            self.move[at] = seed
            for s, k in zip(slots, own):
                self.key[s], self.value[s] = k, keys[k]
        free = iter([s for s in range(n) if self.key[s] is None])
        for at, own in buckets.items():
            if len(own) == 1:
                s = next(free)
                self.move[at], self.key[s], self.value[s] = -s - 1, own[0], keys[own[0]]

    def get(self, k: bytes) -> int:
        """The value of a key, or -1."""
        if not self.n:
            return -1
        d = self.move[xxhash.xxh3_64_intdigest(k) % self.n]
        s = -d - 1 if d < 0 else xxhash.xxh3_64_intdigest(k, d) % self.n
        return self.value[s] if self.key[s] == k else -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a rank file (``base64 rank`` per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """Merges the bytes of pre-tokens that are not themselves tokens; remembers the ranks of neighbours it has met."""

    def __init__(self, vocabulary: PerfectHash, token: dict[int, bytes]) -> None:
        self.vocabulary, self.token, self.pairs = vocabulary, token, {}
        self.byte = [vocabulary.get(bytes([i])) for i in range(256)]

    def rank(self, pair: int) -> int:
        """The id that the pair ``left << 32 | right`` merges to, or -1; ids are ranks."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        r = self.pairs[pair] = self.vocabulary.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF])
        return r

    def merge(self, piece: bytes) -> tuple[int, ...]:
        n, known, rank, byte = len(piece), self.pairs.get, self.rank, self.byte
        part = [byte[x] for x in piece]
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        best = [-1] * n  # the rank at which the symbol at a place merges with its right neighbour
        for i in range(n - 1):
            pair = part[i] << 32 | part[i + 1]
            if (r := known(pair)) is None:
                r = rank(pair)
            if r >= 0:
                best[i] = r
                heap.append(r << 32 | i)
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if best[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i], part[j], best[j], best[i] = r, -1, -1, -1
            if k < n:
                before[k] = i
                pair = r << 32 | part[k]
                if (q := known(pair)) is None:
                    q = rank(pair)
                if q >= 0:
                    best[i] = q
                    heappush(heap, q << 32 | i)
            if (h := before[i]) >= 0:
                pair = part[h] << 32 | r
                if (q := known(pair)) is None:
                    q = rank(pair)
                if q >= 0 and q != best[h]:
                    heappush(heap, q << 32 | h)
                best[h] = q
        return tuple([p for p in part if p >= 0])


class Encoder:
    """Encodes and decodes texts; built once per task from the broadcast vocabulary."""

    def __init__(self, vocabulary: PerfectHash, pattern: str) -> None:
        self.vocabulary, self.pattern, self.memo, self.older = vocabulary, regex.compile(pattern), {}, {}
        self.fast = _FAST if pattern == KNOWN_PATTERN else None
        self.token: dict[int, bytes] = {v: k for k, v in zip(vocabulary.key, vocabulary.value) if k is not None}
        self.merger = Merger(vocabulary, self.token)

    def ids_of(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            whole = self.vocabulary.get(data)
            ids = (whole,) if whole >= 0 else self.merger.merge(data)
        if len(self.memo) >= MEMO:
            self.memo, self.older = {}, self.memo
        self.memo[piece] = ids
        return ids

    def stretches(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in lists of bounded length."""
        split = self.fast if self.fast and not _OUTSIDE.search(text) else self.pattern
        pieces = map(lambda m: m.group(), split.finditer(text)) if len(text) > STRETCH else iter(split.findall(text))
        new = self.ids_of
        while part := list(islice(pieces, STRETCH)):
            known = self.memo.get
            yield [i for p in part for i in known(p) or new(p)]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stretches(text) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _vocabulary(df: DataFrame, ranks_path: str):
    return df.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(ranks_path)))


def encode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``df`` with its ``text`` column replaced by ``ids`` (array of int) and ``n_tokens`` (long)."""
    small_batches(df.sparkSession)
    shared = _vocabulary(df, ranks_path)
    keep = [f for f in df.schema.fields if f.name not in ("text", "ids", "n_tokens")]
    names = [f.name for f in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "ids array<int>", "n_tokens long"])

    def run(batches):
        coder = Encoder(shared.value, pattern)
        for b in batches:
            flat, ends = array("i"), [0]
            for text in b.column(b.schema.get_field_index("text")):
                for ids in coder.stretches(text.as_py() or ""):
                    flat.extend(ids)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32()))
            counts = pa.array([y - x for x, y in zip(ends, ends[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], ids, counts],
                                             names=[*names, "ids", "n_tokens"])

    return df.select(*names, "text").mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text is encoded, its ids are decoded again, both are digested."""
    small_batches(df.sparkSession)
    shared = _vocabulary(df, ranks_path)

    def run(batches):
        coder = Encoder(shared.value, pattern)
        written = {i: str(i) for i in coder.token}
        for b in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                ids_digest, text_digest, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in coder.stretches(text.as_py() or ""):
                    ids_digest.update((" " if n else "").encode() + " ".join(map(written.__getitem__, ids)).encode())
                    text_digest.update(coder.decode(ids))
                    n += len(ids)
                n_tokens.append(n)
                ids_sha.append(ids_digest.hexdigest())
                text_sha.append(text_digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
