"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words are runs of letters and digits without regard to case, so punctuation and case do not hide a copy. Every 3-gram of a test
item is a seed: which of them an edit or a cut destroys is not known beforehand, so none is left out, however frequent. A document
and an item with a seed in common are aligned around it, unless too few of the item's words stand there for the threshold:
match +2, mismatch -1, gap -1. The score is the best local alignment over the item's full score; the pair counts from
``threshold`` on. A copy without three words in a row as in the item has no seed and is not found.

The items are the stated query set: they are handed to the tasks in blocks of at most ``BLOCK`` n-grams; more items are more
blocks over the same documents, never more memory.

Nulls: a null or empty text of either side has no words and matches nothing; null ids are carried. Items below three words
are looked for as one n-gram of their own length. Repeated documents and items each give their rows. Very long texts are
aligned around their seeds only, whole texts are searched for seeds. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .text import NOT_LETTER, mix, ngram_hashes, pieces, utf8, word_hashes

GRAM, THRESHOLD = 3, 0.45
MATCH, MISMATCH, GAP = 2, -1, 1
BLOCK = 1 << 19


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(best local score, end in item, end in text) by Smith-Waterman over word hashes, a row at a time."""
    step = np.arange(len(text) + 1) * GAP
    row, best = np.zeros(len(text) + 1, np.int64), (0, 0, 0)
    for i, w in enumerate(item, 1):
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(text == w, MATCH, MISMATCH), row[1:] - GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + step) - step  # gaps along the row
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i, j)
        row = new
    return best


def align_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(best score, first and end word in text of the best alignment)."""
    score, i, j = align(item, text)
    if not score:
        return 0, 0, 0
    _, _, back = align(item[:i][::-1], text[:j][::-1])
    return score, j - back, j


def folded(column: pa.Array) -> pa.Array:
    """The texts in lower case, by way of upper case: letters with two small forms (final sigma, long s) become one."""
    return pc.utf8_lower(pc.utf8_upper(column.cast(pa.large_string())))


class Items:
    """A block of test items: words, sorted n-grams and which item has each."""

    def __init__(self, ids: list, texts: list):
        data, off = utf8(folded(pa.array(texts, pa.string())))
        w, woff = word_hashes(data, off, NOT_LETTER)
        self.ids, self.words = ids, [w[a:b] for a, b in zip(woff[:-1], woff[1:], strict=True)]
        grams, owner = [], []
        for k, x in enumerate(self.words):
            n = min(GRAM, len(x))
            if n:
                g = np.unique(gram_hashes(x, n))
                grams.append(g)
                owner.append(np.full(len(g), k))
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.sizes = sorted({min(GRAM, len(x)) for x in self.words if len(x)})

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram, item) of all items, by n-gram."""
        o = np.argsort(self.gram, kind="stable")
        return self.gram[o], self.owner[o]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    return mix(ngram_hashes(words, n) + np.uint64(n))


def _flags(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(grams >> np.uint64(44)).astype(np.int64)] = True
    return out


def _hits(words: np.ndarray, sizes: list[int], sorted_grams: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, size, n-gram) of each place where one of the n-grams stands."""
    at, size, found = [], [], []
    for n in sizes:
        h = gram_hashes(words, n)
        p = np.flatnonzero(flags[(h >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(sorted_grams, h[p])
        ok = sorted_grams[np.minimum(k, len(sorted_grams) - 1)] == h[p]
        at.append(p[ok])
        size.append(np.full(int(ok.sum()), n))
        found.append(h[p[ok]])
    return np.concatenate(at), np.concatenate(size), np.concatenate(found)


def _text_pieces(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words, document borders) of bounded pieces of a batch."""
    data, off = utf8(folded(batch.column(k)))
    for a, b in pieces(off):
        w, woff = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], NOT_LETTER)
        yield a, w, woff


def _inside(at: np.ndarray, size: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document of each hit, and whether the hit ends in it."""
    doc = np.searchsorted(woff, at, "right") - 1
    return doc, at + size <= woff[doc + 1]


PAIRS = "doc_id long, item_id long, score double, first_word long, end_word long, seeds long"


def matcher(docs: DataFrame, items: Items, threshold: float):
    """A function from a batch and its text column's place to (row, item, score, first word, end word, seeds) of its matches."""
    gram, owner = items.seeds()
    words, sizes = items.words, items.sizes
    sent = docs.sparkSession.sparkContext.broadcast((gram, owner, words))  # a block's, of bounded size

    def candidates(doc: np.ndarray, at: np.ndarray, item: np.ndarray, g: np.ndarray, words: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, int]]:
        if not len(doc):
            return
        o = np.lexsort((at, item, doc))
        doc, at, item, g = doc[o], at[o], item[o], g[o]
        edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        for i, j in zip(edge, np.append(edge[1:], len(doc)), strict=True):
            k = int(item[i])
            far = np.flatnonzero(np.diff(at[i:j]) > 2 * len(words[k])) + 1
            for part in np.split(np.arange(i, j), far):
                yield int(doc[i]), k, at[part], len(np.unique(g[part]))

    def matches(b: pa.RecordBatch, column: int) -> Iterator[tuple]:
        gram, owner, words = sent.value
        grams = np.unique(gram)
        flags = _flags(grams)
        for row, w, woff in _text_pieces(b, column):
            at, size, g = _hits(w, sizes, grams, flags)
            doc, ok = _inside(at, size, woff)
            at, g, doc = at[ok], g[ok], doc[ok]
            lo, hi = np.searchsorted(gram, g), np.searchsorted(gram, g, "right")
            n = hi - lo
            who = owner[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            best: dict[tuple[int, int], tuple] = {}
            for d, k, places, seeds in candidates(np.repeat(doc, n), np.repeat(at, n), who, np.repeat(g, n), words):
                margin = len(words[k]) + 8
                a, e = max(woff[d], places[0] - margin), min(woff[d + 1], places[-1] + margin + GRAM)
                if np.isin(words[k], w[a:e]).sum() / len(words[k]) < threshold:  # even with all of them matched
                    continue
                score, i, j = align(words[k], w[a:e])
                share = score / (MATCH * len(words[k]))
                if share >= threshold and share > best.get((d, k), (0,))[0]:
                    _, i, j = align_span(words[k], w[a:e])
                    best[d, k] = (share, int(a + i - woff[d]), int(a + j - woff[d]), seeds)
            for (d, k), v in best.items():
                yield row + d, k, *v

    return matches


def _block_pairs(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    if not len(items.gram):
        return docs.sparkSession.createDataFrame([], PAIRS)
    matches, ids = matcher(docs, items, threshold), items.ids
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            doc_ids = b.column(0).cast(pa.int64())
            out = [(doc_ids[row].as_py(), ids[k], *v) for row, k, *v in matches(b, 1)]
            if out:
                z = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(z, types, strict=True)], [x.split()[0] for x in PAIRS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), PAIRS)


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, a block of about ``BLOCK`` n-grams at a time."""
    ids, texts, load = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        load += len(r["text"] or "") // 4
        if load > BLOCK:
            yield Items(ids, texts)
            ids, texts, load = [], [], 0
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item whose best alignment is at or above the threshold."""
    out = None
    for items in item_blocks(benchmark):
        part = _block_pairs(docs, items, threshold)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs less the rows that hold a copy of an item, whatever their doc_id. Each block of items is one pass, without a shuffle."""
    k, out = docs.columns.index("text"), docs
    for items in item_blocks(benchmark):
        if not len(items.gram):
            continue
        matches = matcher(docs, items, threshold)

        def run(batches, matches=matches):
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[row for row, *_ in matches(b, k)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
