"""Suffix-array dedup: repeated byte strings by column-wise construction over many short documents.

Every 100-byte window is dealt by its minimizer, the least hash of its 16-byte strings, so equal windows meet. Runs of windows
with one minimizer travel as one segment. Segments of equal content are settled by their digest, inside each batch before
any shuffle and then across batches: all but the first are repeats. Equal windows also have their minimizer at one offset. So
windows are parted by ``CUTS`` of that offset, and the bytes that all windows of a part have in common, its core, are equal
too. Only first segments that share a core with another content need the bytes of that part, and the core deals them out.

A window whose hash comes only once in its core's group is no repeat. The others are the documents of the column-wise
construction (``ColumnIndex``): from the right, each round inserts one symbol of every document, updating the suffix order, the
collection's BWT and the common prefixes. Windows with a common prefix of 100 bytes are one class; all but its first are repeats.

A symbol is a block of ``WIDTH`` bytes; so a window is four symbols. A group's windows go by their hash, ``CHUNK`` at a time,
with the distinct ones of the hash that goes on; a chunk's collection stays in memory as sequential arrays instead of files.

Ids: order is by doc_id, nulls first. If ids repeat, the rows are put in one order first and the later counts as later.
Null and empty texts have no windows and stay as they are. Very long texts are cut into overlapping sections, whose windows
are all judged. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEPT, lean, shuffle_parts, stored, with_key
from .text import mix, power_table, utf8

WINDOW, GRAM, WIDTH = 100, 16, 25
SECTION = 1 << 19
#: Bytes of a batch of groups, windows of a collection, and windows whose hashes are held at once.
BATCH, CHUNK, HELD = 1 << 20, 1 << 16, 1 << 22
#: Parts of the offset of the minimizer in the window; a part's windows have all but its width of their bytes in common.
CUTS = (0, 22, 43, 64, WINDOW - GRAM + 1)

_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """_B**k and its inverse, modulo 2**64, for k up to a section's length."""
    if __name__ not in KEPT:
        KEPT[__name__] = tuple(power_table(SECTION + 2 * WINDOW + 2, base) for base in (_B, _BI))
    return KEPT[__name__]


def words8(data: np.ndarray) -> np.ndarray:
    """The 64-bit word that starts at each byte (seven fewer than bytes)."""
    n = len(data) - 7
    out, raw = np.empty(max(n, 0), np.uint64), np.ascontiguousarray(data)
    for j in range(min(8, max(n, 0))):
        k = (len(raw) - j) // 8
        out[j::8] = raw[j : j + 8 * k].view(np.uint64)[: len(out[j::8])]
    return out


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: document, start in it, windows, minimizer's hash, content's hash, the minimizer's offset in
    the first window, and a hash of the core of each part (0 where the run has no window of it)."""
    out: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, int]] = []  # document, first byte, end byte

    def flush() -> None:
        if not group:
            return
        pw, inv = _tables()
        d = np.concatenate([data[a:b] for _, a, b in group])
        size = np.array([b - a for _, a, b in group])
        at = np.cumsum(size) - size
        v = words8(d)
        h = mix(v[:-8] ^ (v[8:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9))
        m = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
        span, s = WINDOW - GRAM + 1, 1
        while 2 * s <= span:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        if span > s:
            m = np.minimum(m[: -(span - s)], m[span - s :])
        where = (m & np.uint64((1 << 21) - 1)).astype(np.int64)
        good = np.zeros(len(d) + 1, np.int8)
        good[at] += 1
        np.add.at(good, at + size - WINDOW + 1, -1)
        good = np.cumsum(good)[: len(where)] > 0
        edge = np.ones(len(where), bool)
        edge[1:] = where[1:] != where[:-1]
        edge[at[at < len(edge)]] = True
        edge |= np.concatenate([[True], good[1:] != good[:-1]])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(where)))
        keep = good[first]
        first, count = first[keep], count[keep]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((d.astype(np.uint64) + np.uint64(1)) * pw[: len(d)], dtype=np.uint64)])
        content = mix((total[first + count + WINDOW - 1] - total[first]) * inv[first] + count.astype(np.uint64))
        lead = where[first] - first
        cores = np.zeros((len(first), len(CUTS) - 1), np.uint32)
        for k, (low, high) in enumerate(zip(CUTS[:-1], CUTS[1:], strict=True)):
            q = np.flatnonzero((lead >= low) & (lead - count < high - 1))
            a = where[first[q]] - low
            cores[q, k] = mix((total[a + WINDOW + low - high + 1] - total[a]) * inv[a]) >> np.uint64(32)
        doc = np.searchsorted(at, first, "right") - 1
        base = np.array([g[1] for g in group]) - off[[g[0] for g in group]]
        out.append((np.array([g[0] for g in group])[doc], first - at[doc] + base[doc], count, h[where[first]], content, lead, cores))
        group.clear()

    held = 0
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        while b - a >= WINDOW:
            end = min(b, a + SECTION)
            if held + end - a > SECTION:
                flush()
                held = 0
            group.append((i, a, end))
            held += end - a
            if end == b:
                break
            a = end - WINDOW + 1
    flush()
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64), np.zeros(0, np.uint64), e, np.zeros((0, len(CUTS) - 1), np.uint32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class ColumnIndex:
    """Suffix order, BWT and common prefixes of many documents of symbols, built one column from the right at a time.

    ``symbols``: all documents' symbols, concatenated; ``start``: where each begins (one entry more than documents).
    After ``build``: ``suffix`` (place in ``symbols``) in suffix order, ``lcp`` with the one before (at most ``cap``), ``bwt``
    (symbol before the suffix, -1 at a document's start).
    """

    def __init__(self, symbols: np.ndarray, start: np.ndarray, cap: int):
        self.symbols, self.start, self.cap = symbols.astype(np.int64), start.astype(np.int64), cap

    def build(self) -> ColumnIndex:
        e = np.zeros(0, np.int64)
        self.suffix, self.pred, self.sym, self.lcp, self.bwt = e, e, e, np.zeros(0, np.int8), e
        length = np.diff(self.start)
        docs = np.flatnonzero(length > 0)
        at = np.full(len(length), -1)  # place of each document's last inserted suffix
        for column in range(1, int(length.max(initial=0)) + 1):
            docs = docs[length[docs] >= column]
            self._insert(docs, self.start[docs + 1] - column, at)
        return self

    def _insert(self, docs: np.ndarray, place: np.ndarray, at: np.ndarray) -> None:
        new_sym, new_pred, n = self.symbols[place], at[docs], len(self.suffix)
        key_old = (self.sym << 32) | (self.pred + 1)
        key_new = (new_sym << 32) | (new_pred + 1)
        order = np.argsort(key_new, kind="stable")
        docs, place, new_sym, new_pred = docs[order], place[order], new_sym[order], new_pred[order]
        ins = np.searchsorted(key_old, key_new[order], "right")
        moved = np.arange(n) + np.cumsum(np.bincount(ins, minlength=n + 1))[:n]
        put = ins + np.arange(len(ins))
        size = n + len(ins)

        def merged(old: np.ndarray, new: np.ndarray) -> np.ndarray:
            out = np.empty(size, old.dtype)
            out[moved], out[put] = old, new
            return out

        pred_before = merged(self.pred, new_pred)  # in the order before this column: for the common prefixes
        sym = merged(self.sym, new_sym)
        lcp = merged(self.lcp, np.zeros(len(ins), np.int8))
        touched = np.unique(np.concatenate([put, put + 1]))
        touched = touched[(touched > 0) & (touched < size)]
        same = touched[sym[touched] == sym[touched - 1]]
        lcp[touched] = 0
        if len(same):
            a, b = pred_before[same - 1], pred_before[same]
            got = np.ones(len(same), np.int8)
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            deep = np.ones(len(a), np.int8)
            for v in range(1, self.cap):  # the least common prefix between a and b is v at least
                low = np.maximum.accumulate(np.where(self.lcp < v, np.arange(n), -1)) if n else np.zeros(0, np.int64)
                deep += (low[b] <= a).astype(np.int8)
            got[both] = deep
            lcp[same] = np.minimum(got, self.cap)
        if size:
            lcp[0] = 0
        remap = np.append(moved, -1)
        self.pred = np.where(pred_before >= 0, remap[pred_before], -1)
        before = np.where(place > self.start[docs], self.symbols[place - 1], -1)
        self.suffix, self.bwt = merged(self.suffix, place), merged(self.bwt, before)
        self.sym, self.lcp = sym, lcp
        # places of all documents' last suffixes: old ones move, new ones are where they were put
        live = at >= 0
        at[live] = moved[at[live]]
        at[docs] = put


def repeated_windows(content: np.ndarray, at: np.ndarray, window: int = WINDOW, width: int = WIDTH) -> np.ndarray:
    """Which of the windows that start at ``at`` equal an earlier one of the list."""
    n, cap = len(at), window // width
    block = np.zeros((n * cap, -(-width // 8) * 8), np.uint8)
    block[:, :width] = np.lib.stride_tricks.sliding_window_view(content, window)[at].reshape(-1, width)
    h = np.zeros(n * cap, np.uint64)
    for word in block.view(np.uint64).T:
        h = mix(h ^ word)
    _, rank = np.unique(h, return_inverse=True)
    index = ColumnIndex(rank, np.arange(0, n * cap + 1, cap), cap).build()
    same = index.lcp >= cap
    many = same.copy()
    many[:-1] |= same[1:]
    cls, doc = np.cumsum(~same)[many], index.suffix[many] // cap
    order = np.lexsort((doc, cls))
    cls, doc = cls[order], doc[order]
    again = np.zeros(n, bool)
    again[doc[1:][cls[1:] == cls[:-1]]] = True
    return again


def window_hashes(content: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at ``at``."""
    pw, inv = _tables()
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), SECTION):
        q = at[i : i + SECTION]
        for a in range(int(q.min()), int(q.max()) + 1, SECTION):
            here = slice(*np.searchsorted(q, [a, a + SECTION]))
            d = content[a : a + SECTION + WINDOW].astype(np.uint64) + np.uint64(1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(d * pw[: len(d)], dtype=np.uint64)])
            p = q[here] - a
            out[i : i + SECTION][here] = mix((total[p + WINDOW] - total[p]) * inv[p])
    return out


def repeats_of_groups(content: np.ndarray, start: np.ndarray, count: np.ndarray, rid: np.ndarray, pos: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window's offset in it) of windows that equal one of lesser (rid, pos) in their group. Segments lie one after another in
    ``content``; ``start`` has one entry more."""
    upto = np.cumsum(count)
    held = max(-(-int(count.sum()) // HELD), 1)
    seg_out, off_out = [], []
    for part in range(held):
        kept = []
        for i in range(0, int(upto[-1]), SECTION):
            w = np.arange(i, min(i + SECTION, int(upto[-1])))
            s = np.searchsorted(upto, w, "right")
            x = mix(window_hashes(content, start[s] + w - (upto - count)[s]) ^ group[s])
            q = x % np.uint64(held) == part
            kept.append((w[q], x[q]))
        w, x = (np.concatenate(z) for z in zip(*kept, strict=True))
        o = np.argsort(x, kind="stable")
        w, x = w[o], x[o]
        same = x[1:] == x[:-1]
        many = np.append(same, False) | np.append(False, same) if len(x) else np.zeros(0, bool)
        w, x = w[many], x[many]
        s = np.searchsorted(upto, w, "right")
        off = w - (upto - count)[s]
        o = np.lexsort((pos[s] + off, rid[s], x))
        s, off, x = s[o], off[o], x[o]
        carry = np.zeros(0, np.int64)
        for i in range(0, len(x), CHUNK):
            q = np.append(carry, np.arange(i, min(i + CHUNK, len(x))))
            again = repeated_windows(content, start[s[q]] + off[q])
            seg_out.append(s[q[again]])
            off_out.append(off[q[again]])
            carry = q[~again & (x[q] == x[q[-1]])]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + seg_out), np.concatenate(none + off_out)


def _runs(rid: np.ndarray, pos: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges with neighbours joined."""
    o = np.lexsort((pos, rid))
    rid, pos, end = rid[o], pos[o], (pos + count)[o]
    if not len(rid):
        return rid, pos, end
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (pos[1:] > end[:-1])
    first = np.flatnonzero(new)
    return rid[first], pos[first], np.maximum.reduceat(end, first) - pos[first]


RANGE = "rid long, pos long, count long, core long"


def _range_batch(rid, pos, count, core=None) -> pa.RecordBatch:
    m = pa.nulls(len(rid), pa.int64()) if core is None else pa.array(core.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (rid, pos, count)] + [m], ["rid", "pos", "count", "core"])


def settle_equal_segments(docs: DataFrame) -> DataFrame:
    """Stored: repeated window ranges (core null), and the parts of segments whose bytes must be compared.

    ``docs``: rid, text. Segments travel as a few rows of packed arrays for each bucket of minimizers.
    """
    buckets = 2 * max(shuffle_parts(docs.sparkSession), 12)

    def send(batches):
        names = ["bucket", "h", "c", "rid", "pos", "count", "lead", "cores"]
        nothing = lambda k, t: pa.nulls(k, t)
        for b in batches:
            data, off = utf8(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            doc, pos, count, h, c, lead, cores = segments(data, off)
            rid = ids[doc]
            key = mix(h ^ mix(c))
            o = np.lexsort((pos, rid, key))
            new = np.ones(len(o), bool)
            new[1:] = key[o][1:] != key[o][:-1]
            r, p, n = _runs(rid[o[~new]], pos[o[~new]], count[o[~new]])
            if len(r):
                yield pa.RecordBatch.from_arrays([nothing(1, pa.int32()), nothing(1, pa.binary()), nothing(1, pa.binary()), *(pa.array([x.astype(np.int64).tobytes()]) for x in (r, p, n)), nothing(1, pa.binary()), nothing(1, pa.binary())], names)
            o = o[new]
            to = (h[o] % np.uint64(buckets)).astype(np.int64)
            o = o[np.argsort(to, kind="stable")]
            cut = np.searchsorted((h[o] % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
            # order within a bucket by document, which packs better
            for k0 in range(0, buckets, 64):
                rows = []
                for k in range(k0, min(k0 + 64, buckets)):
                    q = np.sort(o[cut[k] : cut[k + 1]])
                    if len(q):
                        rows.append((k, h[q].tobytes(), c[q].tobytes(), rid[q].astype(np.int64).tobytes(), pos[q].astype(np.int64).tobytes(), count[q].astype(np.uint8).tobytes(), lead[q].astype(np.uint8).tobytes(), cores[q].tobytes()))
                if rows:
                    z = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(z[0], pa.int32()), *(pa.array(x, pa.binary()) for x in z[1:])], names)

    def meet(batches):
        by: dict[int, list] = {}
        for b in batches:
            for bucket, *raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if bucket is None:
                    r, p, n = (np.frombuffer(x, np.int64) for x in raw[2:5])
                    yield _range_batch(r, p, n)
                else:
                    by.setdefault(bucket, []).append(raw)
        for raws in by.values():
            h, c, rid, pos = (np.concatenate([np.frombuffer(r[k], d) for r in raws]) for k, d in enumerate((np.uint64, np.uint64, np.int64, np.int64)))
            count, lead = (np.concatenate([np.frombuffer(r[k], np.uint8) for r in raws]).astype(np.int64) for k in (4, 5))
            cores = np.concatenate([np.frombuffer(r[6], np.uint32) for r in raws]).reshape(len(h), -1)
            raws.clear()
            o = np.argsort(h, kind="stable")
            hs = h[o]
            first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
            size = np.diff(np.append(first, len(hs)))
            o = o[np.repeat(size > 1, size)]
            if not len(o):
                continue
            o = o[np.lexsort((pos[o], rid[o], c[o], h[o]))]
            h, c, rid, pos, count = h[o], c[o], rid[o], pos[o], count[o]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            r, p, n = _runs(rid[~new], pos[~new], count[~new])
            if len(r):
                yield _range_batch(r, p, n)
            h, rid, pos, count, o = h[new], rid[new], pos[new], count[new], o[new]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(first, len(h)))
            many = np.repeat(size > 1, size)
            h, rid, pos, count, lead, cores = h[many], rid[many], pos[many], count[many], lead[o[many]], cores[o[many]]
            for k, (low, high) in enumerate(zip(CUTS[:-1], CUTS[1:], strict=True)):
                near, far = np.maximum(lead - count + 1, low), np.minimum(lead, high - 1)  # offsets of the part's last and first window
                q = np.flatnonzero(near <= far)
                group = mix(h[q] ^ mix((cores[q, k].astype(np.uint64) << np.uint64(3)) + np.uint64(k)))
                o = np.argsort(group, kind="stable")
                q, group = q[o], group[o]
                same = group[1:] == group[:-1]
                if same.any():
                    both = np.append(same, False) | np.append(False, same)
                    q, group = q[both], group[both]
                    yield _range_batch(rid[q], pos[q] + lead[q] - far[q], far[q] - near[q] + 1, group)

    schema = "bucket int, h binary, c binary, rid binary, pos binary, count binary, lead binary, cores binary"
    sent = docs.mapInArrow(lean(send), schema).repartition(buckets, F.coalesce("bucket", F.hash("rid")))
    return stored(sent.mapInArrow(lean(meet), RANGE), "segments")


def compare_segments(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Repeated window ranges among segments of different content. ``asked``: rid, pos, count, core."""
    buckets = 2 * max(shuffle_parts(docs.sparkSession), 12)
    by_doc = asked.groupBy("rid").agg(F.collect_list(F.struct("pos", "count", "core")).alias("want"))

    def fetch(batches):
        held, pieces, size = [], [], 0
        for b in batches:
            for i in range(len(b)):
                rid, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                raw = (text or "").encode()
                want = b.column(2).slice(i, 1).flatten()
                pos, count, m = (want.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                held.append((np.full(len(pos), rid, np.int64), pos, count, m))
                pieces += [raw[p : p + n + WINDOW - 1] for p, n in zip(pos.tolist(), count.tolist(), strict=True)]
                size += int(count.sum()) + (WINDOW - 1) * len(pos)
                if size > 4 << 20:
                    yield _packed(held, pieces, buckets)
                    held, pieces, size = [], [], 0
        if held:
            yield _packed(held, pieces, buckets)

    def compare(batches):
        by: dict[int, list] = {}
        for b in batches:
            for bucket, *raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                by.setdefault(bucket, []).append(raw)
        for raws in by.values():
            rid, pos, count, m = (np.concatenate([np.frombuffer(r[k], np.int64) for r in raws]) for k in range(4))
            body = np.frombuffer(b"".join(r[4] for r in raws), np.uint8)
            raws.clear()
            size = count + WINDOW - 1
            at = np.cumsum(size) - size
            o = np.argsort(m, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], m[o][1:] != m[o][:-1]]))
            load = np.cumsum(size[o])
            i = 0
            while i < len(o):  # whole groups, about BATCH bytes
                k = int(np.searchsorted(load, (load[i - 1] if i else 0) + BATCH, "right"))
                j = int(np.searchsorted(new, k, "right")) - 1
                k = int(new[j]) if k < len(o) and new[j] > i else k
                if k < len(o) and k not in new[j : j + 1]:
                    k = int(new[j + 1]) if j + 1 < len(new) else len(o)
                q = o[i:k]
                start = np.append(0, np.cumsum(size[q]))
                group = np.concatenate([body[a : a + n] for a, n in zip(at[q].tolist(), size[q].tolist(), strict=True)])
                s, w = repeats_of_groups(group, start, count[q], rid[q], pos[q], m[q].view(np.uint64))
                r, p, n = _runs(rid[q][s], pos[q][s] + w, np.ones(len(s), np.int64))
                if len(r):
                    yield _range_batch(r, p, n)
                i = k

    sent = docs.join(by_doc, "rid").select("rid", "text", "want").mapInArrow(lean(fetch), "bucket int, rid binary, pos binary, count binary, m binary, body binary")
    return stored(sent.repartition(buckets, "bucket").mapInArrow(lean(compare), RANGE), "repeats")


def _packed(held: list[tuple], pieces: list[bytes], buckets: int) -> pa.RecordBatch:
    """A row of packed arrays and joined bytes for each bucket of cores."""
    cols = [np.concatenate(z) for z in zip(*held, strict=True)]
    to = (cols[-1].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    o = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], to[o][1:] != to[o][:-1]]))
    rows = [(int(to[q[0]]), *(x[q].tobytes() for x in cols), b"".join(pieces[j] for j in q.tolist())) for q in np.split(o, first[1:])]
    z = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(z[0], pa.int32()), *(pa.array(x, pa.binary()) for x in z[1:])], ["bucket", "rid", "pos", "count", "m", "body"])


def repeats(ordered: DataFrame) -> DataFrame:
    """Ranges (rid, pos, count) of windows that also start earlier. ``ordered``: rid, text."""
    docs = ordered.select("rid", "text")
    settled = settle_equal_segments(docs)
    more = compare_segments(docs, settled.filter("core IS NOT NULL"))
    return settled.filter("core IS NULL").union(more).select("rid", "pos", "count")


def covered(n: int, pos: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n bytes the windows cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, pos, 1)
    np.add.at(step, pos + count + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def trimmed(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """docs' columns and rid, n_bytes, n_removed, n_spans, kept (the remaining bytes; ``as_text``: as text without cut characters, null
    where nothing is removed). ``docs``: doc_id, text, and columns of other names."""
    ordered = with_key(docs, "rid")
    ranges = repeats(ordered).groupBy("rid").agg(F.collect_list(F.struct("pos", "count")).alias("gone"))
    joined = ordered.join(ranges, "rid", "left")
    k_text, k_gone = joined.columns.index("text"), joined.columns.index("gone")
    schema = joined.drop("gone").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")

    def run(batches):
        for b in batches:
            data, off = utf8(b.column(k_text))
            gone = b.column(k_gone)
            there = gone.is_valid().to_pylist()
            cols = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            for i in range(len(b)):
                d, removed, spans = data[off[i] : off[i + 1]], 0, 0
                kept = d
                if there[i]:
                    w = gone.slice(i, 1).flatten()
                    mask = covered(len(d), w.field(0).to_numpy(zero_copy_only=False), w.field(1).to_numpy(zero_copy_only=False))
                    removed, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = d[~mask]
                kept = kept.tobytes() if not as_text else kept.tobytes().decode("utf-8", "ignore") if removed else None
                for k, x in zip(cols, (len(d), removed, spans, kept), strict=True):
                    cols[k].append(x)
            old = [c for j, c in enumerate(b.columns) if j != k_gone]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(cols[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(cols["kept"], pa.string() if as_text else pa.binary())], names=[f.name for f in schema])

    return joined.mapInArrow(lean(run), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return trimmed(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def dedup_texts(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes (cut characters go too) and without documents of which nothing is left; n_chars follows.

    The input's row travels as one struct, so its columns may have any names; the text goes beside it, and only texts that change come back anew.
    """
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    kept = trimmed(rows, as_text=True).filter("n_removed < n_bytes OR n_bytes = 0")
    cut = F.col("n_removed") > 0

    def value(c: str):
        old = F.col("text") if c == "text" else F.col("row")[c]
        new = {"text": F.when(cut, F.col("kept")).otherwise(old), "n_chars": F.when(cut, F.length("kept")).otherwise(old)}.get(c, old)
        return new.cast(docs.schema[c].dataType).alias(c)

    return kept.select(*map(value, docs.columns))
