"""Packing: documents concatenated and cut into sequences of a fixed length.

Pass one tokenizes each input partition, keeps the ids with their place in the partition and so gives the partition's total.
The totals' prefix sums (one number for each input partition, what the scheduler keeps a task for anyway) give each
partition's global offset. Pass two cuts: token g goes to sequence g // length; a document that crosses a border yields a
boundary record (piece) on either side. Only the last sequence has padding.

Texts are cut where the tokenizer's own pre-tokenizer always cuts, by byte classes; Arrow numbers the distinct pieces of a few MB of
text, and only pieces that the worker has not met are tokenized. ``knows`` states which tokenizers allow that; with any other
whole texts are tokenized.

Nulls: a null text is an empty one (its end mark only); a null doc_id stays null. Repeated ids are separate documents.
Long texts become many pieces. Empty tables give no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEPT, lean, stored
from .text import LOWER, pieces, utf8

LENGTH, END_ID = 2048, 1
#: Bytes of text that are cut at once, most bytes of a piece that is remembered, and most bytes of all remembered pieces and ids.
CHUNK, LONG, MEMORY = 4 << 20, 48, 64 << 20

#: Byte classes: 0 blank, 1 letter (ASCII, and all bytes of U+00C0 to U+024F), 2 digit, 3 other ASCII sign, 4 whatever else.
KIND = np.full(256, 4, np.uint8)
KIND[[32, 9, 10, 13]] = 0
KIND[33:127] = 3
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
KIND[48:58] = 2
KIND[39] = 4  # an apostrophe may begin an English ending

#: The parts of a tokenizer's description that ``cuts`` relies on.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


def knows(path: str) -> bool:
    """Whether the tokenizer drops white space and cuts as ``cuts`` does: runs of letters, single digits, runs of other signs."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    split = (pre.get("pretokenizers") or [{}])[0]
    return (
        [x["type"] for x in norm.get("normalizers", [])] == NORMALIZERS
        and norm["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and split.get("pattern") == {"Regex": SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
        and [x["type"] for x in pre["pretokenizers"][1:]] == ["ByteLevel"] and not pre["pretokenizers"][1]["add_prefix_space"] and not pre["pretokenizers"][1]["use_regex"]
    )


def cuts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case without blanks, where pieces begin in them, and the first piece of each document (one entry more than documents).

    A word (between blanks) is cut at each change of class and between digits; a word stays whole that has any byte of class 4, a sign
    among the letters (U+00D7, U+00F7) or the letter whose lower case ends in an accent of its own (U+0130).
    """
    kind = KIND[data]
    full = kind != 0
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge = off[1:-1][off[1:-1] < len(data)]
    first[edge] = True
    odd = np.flatnonzero(kind == 4)
    sign = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xC4))
    after = data[sign + 1]
    sign = sign[np.where(data[sign] == 0xC3, (after == 0x97) | (after == 0xB7), after == 0xB0)]
    if len(odd) or len(sign):
        word = full.copy()
        word[1:] &= ~full[:-1]
        word[edge] = full[edge]
        begin = np.flatnonzero(word)
        k = np.unique(np.searchsorted(begin, np.concatenate([odd, sign]), "right") - 1)
        end = np.append(begin, len(data))[k + 1]
        change = np.zeros(len(data) + 1, np.int8)
        change[begin[k]] += 1
        change[end] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8) > 0
        first &= ~inside | word
    upto = np.append(0, np.cumsum(full))
    begin = np.flatnonzero(first[full])
    return LOWER[data[full]], begin, np.searchsorted(begin, upto[off])


class Encoder:
    """Token ids of texts, with a table of pieces that is emptied when it takes ``MEMORY`` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.fine = Tokenizer.from_file(path), knows(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.start, self.count, self.used, self.bytes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def _ids(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and how many each has: one text of them all, told apart by the ids' places in it."""
        e = self.tok.encode(" ".join(some), add_special_tokens=False)
        size = np.fromiter(map(len, some), np.int64, len(some)) + 1
        place = np.array([a for a, _ in e.offsets], np.int64)
        return np.array(e.ids, np.uint32), np.bincount(np.searchsorted(np.cumsum(size) - size, place, "right") - 1, minlength=len(some))

    def _learn(self, new: list[bytes]) -> None:
        for k in range(0, len(new), 2048):
            some = new[k : k + 2048]
            ids, count = self._ids([x.decode() for x in some])
            n = len(self.index)
            while n + len(some) > len(self.start):
                self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[n : n + len(some)] = self.used + np.cumsum(count) - count
            self.count[n : n + len(some)] = count
            self.index.update(zip(some, range(n, n + len(some)), strict=True))
            self.used += len(ids)
            self.bytes += sum(map(len, some)) + 150 * len(some) + 4 * len(ids)

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids, each document's followed by ``end_id``, and their number by document."""
        if not self.fine:
            each = [self.tok.encode(bytes(data[a:b]).decode(), add_special_tokens=False).ids for a, b in zip(off[:-1], off[1:], strict=True)]
            n = np.array([len(x) + 1 for x in each], np.int64)
            return np.concatenate([np.array([*x, end_id], np.uint32) for x in each]) if each else np.zeros(0, np.uint32), n
        if self.bytes > MEMORY:
            self.clear()
        body, begin, first = cuts(data, off)
        if len(begin):
            raw = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(body)).astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
            kinds = raw.dictionary.to_pylist()
            long = [k for k, x in enumerate(kinds) if len(x) > LONG]
            place = list(map(self.index.get, kinds))
            self._learn([x for x, at in zip(kinds, place, strict=True) if at is None and len(x) <= LONG])
            place = np.array([-1 if at is None else at for at in map(self.index.get, kinds)], np.int64)
            start, count, flat = self.start[place], self.count[place], self.flat
            if long:  # used once, not remembered
                ids, n = self._ids([kinds[k].decode() for k in long])
                count[long], start[long] = n, self.used + np.cumsum(n) - n
                flat = np.concatenate([flat[: self.used], ids])
            at = raw.indices.to_numpy()
            start, count = start[at], count[at]
        else:
            start = count = np.zeros(0, np.int64)
            flat = self.flat
        upto = np.append(0, np.cumsum(count))
        n = np.diff(upto[first])
        out = np.empty(int(upto[-1]) + len(n), np.uint32)
        marks = np.cumsum(n + 1) - 1
        out[marks] = end_id
        inner = np.ones(len(out), bool)
        inner[marks] = False
        out[inner] = flat[np.repeat(start - upto[:-1], count) + np.arange(upto[-1])]
        return out, n + 1


def _encoder(path: str) -> Encoder:
    known = KEPT.setdefault(__name__, {})
    if path not in known:
        known[path] = Encoder(path)
    return known[path]


IDS = "part int, doc_id long, local long, n long, ids binary"


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Pass one, stored: each document's ids (little-endian unsigned 32-bit), its input partition and its place there."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, part, local = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            doc = b.column(0).cast(pa.int64())
            data, off = utf8(b.column(1))
            for i, j in pieces(off, CHUNK):
                ids, n = enc.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
                upto = np.append(0, np.cumsum(n))
                raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(upto * 4), pa.py_buffer(ids.astype("<u4"))])
                if upto[-1] < 1 << 29:
                    raw = raw.cast(pa.binary())
                at = pa.array(local + upto[:-1])
                local += int(upto[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), doc.slice(i, j - i), at, pa.array(n), raw], ["part", "doc_id", "local", "n", "ids"])

    return stored(docs.select("doc_id", "text").mapInArrow(lean(run), IDS), "tokens")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pass two: the pieces of all documents."""
    totals = tokens.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("total")).collect()
    base, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]] = at
        at += r["total"]

    def run(batches):
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in batches:
            local, n = (b.column(k).to_numpy() for k in (2, 3))
            g = local + np.array([base[p] for p in b.column(0).to_pylist()], np.int64)
            many = (g + n - 1) // length - g // length + 1
            doc = np.repeat(np.arange(len(n)), many)
            sequence = (g // length)[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            low, high = np.maximum(g[doc], sequence * length), np.minimum((g + n)[doc], (sequence + 1) * length)
            start = low - g[doc]
            raw = b.column(4).cast(pa.large_binary())
            body, first = memoryview(raw.buffers()[2]), np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw)]
            a = first[doc] + 4 * start
            crc = [zlib.crc32(body[i:j]) for i, j in zip(a.tolist(), (a + 4 * (high - low)).tolist(), strict=True)]
            cols = [b.column(1).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, high - low, crc, n[doc], sequence, low - sequence * length))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return tokens.select("part", "doc_id", "local", "n", "ids").mapInArrow(lean(run), PIECES)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    return cut(token_table(docs, tokenizer, end_id), length)
