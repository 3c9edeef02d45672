"""Packing documents into sequences by power-of-two decomposition.

A document is its token ids followed by ``end_id``. It is split into pieces whose lengths are powers of two: whole
pieces of ``max_length`` first, then the binary digits of what is left, longest first. Each piece is a sequence of its
own, so no sequence crosses documents and none holds padding. Pieces of equal length form a bucket, from which training
draws its batches; sequences are numbered from 0 through the buckets, longest first, without gaps.

Numbering need not move the ids: each task counts its pieces per bucket while it cuts them, the pieces are stored once
(so a lost executor cannot renumber them), and a table of counts per (bucket, task) is prefix-summed into the first
number of every task. That table has at most 1 + log2(max_length) rows per task and is broadcast if it is small.

Ids come from a tokenizer file of the ``tokenizers`` library whose pre-tokenizer drops white space, as
``word_bpe_49k.json``: no token crosses white space, so ids of a text are those of its white-space separated words,
one after the other. A worker remembers the ids of the words it has met, and those of their parts: a word of ASCII and
Latin letters is cut as the tokenizer's own pattern does and only its unknown parts meet the BPE model; any other word is
encoded whole. Letters alone are one part, and letters before closing marks are two, so most words need no pattern. Either memory is bounded (two generations of ``MEMO`` entries). Words of more than ``LONG`` characters are not
remembered and are cut beside digits, where that tokenizer always cuts. Texts are worked through in stretches, so
memory grows by 4 bytes a token only. The file has a fixed size and is broadcast.

Cases: a null or empty text is the end id alone; repeated rows and rows without an id are documents of their own; ties
cannot occur, as (task, number) is unique; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import store

MAX_LENGTH = 4096
END_ID = 2
MEMO = 250_000
LONG = 1_000
STRETCH = 1 << 20
BROADCAST_ROWS = 200_000
FLUSH = 1 << 22  # ids that a task holds before it hands them on, beside those of one document
_BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Characters at which ``str.split`` cuts but ASCII white space does not.
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of ASCII and the Latin letters of U+00C0 to U+017F, but for U+0130: in composed form, each lower-cased to one letter.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_KNOWN = re.compile(f"[!-~{_LATIN}]+")
_PART = re.compile(f"[{_LATIN}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^0-9{_LATIN}]+")  # letters first: no other branch can begin with one
#: ASCII marks that follow each other in one part; the apostrophe may begin a part of its own.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_ID = attrgetter("id")
#: The set-up of the tokenizer file whose cuts ``_PART`` repeats.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: The printable character that byte-level tokenizers write for each byte: itself, or the next free one from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
_BESIDE_DIGIT = re.compile(r"(?<=[A-Za-z0-9])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


class Memo(dict):
    """``make(key)`` of the keys met last: at most two generations of ``MEMO`` keys."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONG:
            return b"".join(map(self.make, _BESIDE_DIGIT.split(key)))
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model, self.words, self.parts = self.tokenizer.model, Memo(self._word), Memo(self._part)
        # a known normaliser and pre-tokenizer, whose cuts the pattern repeats; any other file is encoded word by word
        set_up = json.loads(tokenizer_json)
        self.cut = _PART.findall if (set_up["normalizer"], set_up["pre_tokenizer"]) == (KNOWN_NORMALIZER, KNOWN_PRE_TOKENIZER) else None

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join(map(_BYTE.__getitem__, part.encode()))  # printable ASCII is written as itself
        return array("I", map(_ID, self.model.tokenize(shown))).tobytes()

    def _word(self, word: str) -> bytes:
        if self.cut and (word.isascii() and word.isprintable() or _KNOWN.fullmatch(word)) and "<|" not in word:
            low = word.lower()
            if low.isalpha():
                return self.parts[low]
            head = low.rstrip(_MARKS)
            if head.isalpha():
                return self.parts[head] + self.parts[low[len(head):]]
            return b"".join(map(self.parts.__getitem__, self.cut(low)))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _BLANK.search(text, at + STRETCH) if len(text) > at + STRETCH else None
            part = text[at:cut.start()] if cut else text[at:]
            at += len(part) + 1
            odd = any(c in part for c in _ODD_ASCII) or not part.isascii() and _ODD.search(part)
            words = _WORD.findall(part) if odd else part.split()
            out.append(b"".join(map(self.words.__getitem__, words)))
        return b"".join(out)


_CODERS: dict[str, WordIds] = {}


def coder_of(tokenizer_json: str) -> WordIds:
    """One coder per Python worker, so that a task finds what tasks before it have met."""
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = WordIds(tokenizer_json)
    return _CODERS[name]


def piece_lengths(n: int, max_length: int) -> list[int]:
    """The lengths into which ``n`` ids are cut."""
    rest = n % max_length
    return [max_length] * (n // max_length) + [1 << k for k in range(max_length.bit_length() - 1, -1, -1) if rest >> k & 1]


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, nth long"


def _cut(docs: DataFrame, tokenizer_path: str, max_length: int, end_id: int) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.asarray([end_id], "<u4").tobytes()

    def batch(rows: list[tuple], data: list[bytes], task: int) -> pa.RecordBatch:
        doc, start, length, tokens, nth = zip(*rows)
        ends = np.concatenate([[0], 4 * np.cumsum(length)]).astype("i4")
        ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))])
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([long(doc), long(start), long(length), ids, long(tokens), long([task] * len(rows)), long(nth)],
                                          names=[f.split()[0] for f in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, counts = coder_of(shared.value), TaskContext.get().partitionId(), {}
        for b in batches:
            rows, data, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = coder.of(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, max_length):
                    nth = counts[length] = counts.get(length, -1) + 1
                    rows.append((doc, start, length, n, nth))
                    data.append(ids[4 * start:4 * (start + length)])
                    start += length
                    held += length
                    if held >= FLUSH:
                        yield batch(rows, data, task)
                        rows, data, held = [], [], 0
            if rows:
                yield batch(rows, data, task)

    return store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES), "pieces", compression="zstd")


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``, one row per piece of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the document's ids before the piece.
    ``max_length`` must be a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError(f"max_length must be a power of two, not {max_length}")
    pieces = _cut(docs, tokenizer_path, max_length, end_id)
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    bucket = counts.groupBy("length").agg(F.sum("n").alias("in_bucket"))
    longest_first = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    bucket = bucket.select("length", F.coalesce(F.sum("in_bucket").over(longest_first), F.lit(0)).alias("before_bucket"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = store(counts.withColumn("before_task", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(bucket, "length").select(
        "length", "task", (F.col("before_bucket") + F.col("before_task")).alias("first")), "first-numbers")
    if first.count() <= BROADCAST_ROWS:  # 24 bytes a row; beyond it Spark chooses, and may deal out the pieces
        first = F.broadcast(first)
    return pieces.join(first, ["length", "task"]).select(
        "doc_id", "start", "length", "ids", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Store sequences with a folder for each bucket (``length=4096`` and so on), for batches of equal length."""
    packed.write.partitionBy("length").parquet(path)
