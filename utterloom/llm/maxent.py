"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

The ``VOCAB`` most frequent words are put into classes by the words they follow (k-means over co-occurrence rows); all other
words are one class of their own. A token's log probability is that of its class plus that of the word in it:

* class: softmax over hashed features of the context (previous word, the word before it, both, and the word three back);
* word in its class: the same softmax at each step down a tree of ``CLASSES`` branches over the features ``DEEP`` (previous word,
  the word before it, both), whose rows are hashed with the tree's node. A step starts from what counts say of its branches after the previous word's bucket (see
  ``word_table``) and is moved from there by its features. Frequent words are leaves of their own; the other words go by the
  digits of their hash, more of them the more words were counted, and a leaf's words share it by smoothed counts, one unit for
  all unseen words. So all words' probabilities sum to 1.

All weights are trained by distributed updates: in each of ``ROUNDS`` rounds every task runs Adagrad over its share of that
round's documents, and the tasks' changes of each feature row are averaged by how often the task saw the row. The table has more
rows the more tokens were counted (see ``row_bits``), up to what a task and the driver can hold.

Counts cover all training documents. Each pass reads texts as word hashes; rare words' counts are met in buckets of hashes, so
only the table of frequent words and the model, both of bounded size, go to every task.

Nulls: a null text is an empty one, scored as its end token; a null doc_id is carried, such rows train. Repeated rows count
and score each. Texts are taken whole. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import block_sums, sum_blocks
from .shared import discard, give_back, lean, shuffle_parts, stored
from .text import mix, pieces, utf8, word_hashes

VOCAB, CLASSES, PREV = 8192, 32, 128
ROW_BITS, DENSE_ROW_BITS, MOST_ROW_BITS, ROUNDS, RATE = 14, 18, 19, 3, 0.25
DIGIT, MOST_DIGITS = 5, 3
FEATURES = 5
#: Tokens of an update and of a scored batch, bits of a step's place in an update, rows that are added up at once.
STEP, PLACE, BLOCK = 4096, 16, 16
#: Features of the steps below the root: their bias is what they start from, and the word three back says nothing more there.
DEEP = [1, 2, 4]
END = np.uint64(0x5851F42D4C957F2D)
FOLDS, HELD = 7, 2


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def token_pieces(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, tokens, borders): word hashes with an end token after each document's."""
    data, off = utf8(batch.column(k))
    for a, b in pieces(off):
        rows = np.arange(a, b)
        w, woff = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        size = np.diff(woff) + 1
        border = np.append(0, np.cumsum(size))
        tokens = np.empty(border[-1], np.uint64)
        ends = border[1:] - 1
        tokens[ends] = END
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = w
        yield rows, tokens, border


def _train_rows(b: pa.RecordBatch, round_: int | None = None) -> pa.RecordBatch:
    """The rows that train, or train in this round: only their texts are read as words."""
    ids = b.column(0).to_pylist()
    return b.filter(pa.array([not held_out(i) and (round_ is None or zlib.crc32(f"round {i}".encode()) % ROUNDS == round_) for i in ids], pa.bool_()))


def count_tokens(docs: DataFrame) -> DataFrame:
    """Stored: bucket, and the packed hashes and counts of all training tokens in it."""
    buckets = max(shuffle_parts(docs.sparkSession), 12)

    def packed(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        to = (h % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[o], np.arange(buckets + 1))
        rows = [(k, h[o[i:j]].tobytes(), n[o[i:j]].tobytes()) for k, i, j in zip(range(buckets), cut, cut[1:], strict=False) if i < j]
        if rows:
            z = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(z[0], pa.int32()), pa.array(z[1], pa.binary()), pa.array(z[2], pa.binary())], ["bucket", "h", "c"])

    def send(batches):
        held, size = [], 0
        for b in batches:
            for _, tokens, _ in token_pieces(_train_rows(b), 1):
                h, n = np.unique(tokens, return_counts=True)
                held.append((h, n.astype(np.int64)))
                size += len(h)
                if size > 1 << 21:
                    yield from packed(*merged(held))
                    held, size = [], 0
        if held:
            yield from packed(*merged(held))

    def meet(batches):
        by: dict[int, list] = {}
        for b in batches:
            for k, h, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                by.setdefault(k, []).append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)))
        for k, parts in by.items():
            h, c = merged(parts)
            parts.clear()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["bucket", "h", "c"])

    schema = "bucket int, h binary, c binary"
    sent = docs.select("doc_id", "text").mapInArrow(lean(send), schema)
    return stored(sent.repartition(buckets, "bucket").mapInArrow(lean(meet), schema), "counts")


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and summed counts."""
    h, c = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    o = np.argsort(h, kind="stable")
    h, c = h[o], c[o]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def frequent(counts: DataFrame, most: int = VOCAB) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(hashes, counts) of the most frequent tokens by hash, and N and V. Each bucket gives its own ``most`` at most."""

    def run(batches):
        for b in batches:
            for _, h, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                top = np.lexsort((h, -c))[:most]
                yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(c[top]), pa.array([int(c.sum())] + [0] * (len(top) - 1)), pa.array([len(c)] + [0] * (len(top) - 1))], ["h", "c", "n", "v"])

    rows = stored(counts.mapInArrow(lean(run), "h long, c long, n long, v long"), "frequent")
    n, v = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    top = rows.orderBy(F.desc("c"), "h").limit(most).select("h", "c").toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    o = np.argsort(h)
    return h[o], c[o], int(n), int(v)


def lookup(tokens: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Place of each token in the sorted vocabulary, else its length."""
    n = len(vocab)
    if len(tokens) < 4096 or n > 1 << 16:
        k = np.searchsorted(vocab, tokens)
        k[k == n] = 0
        return np.where(vocab[k] == tokens, k, n) if n else np.zeros(len(tokens), np.int64)
    upper = np.uint64(47)  # the table of upper bits costs less than a search
    begin = np.append(0, np.cumsum(np.bincount((vocab >> upper).astype(np.int64), minlength=1 << 17)))
    k, out = begin.take((tokens >> upper).astype(np.int64)), np.full(len(tokens), n)
    for _ in range(int(np.diff(begin).max())):
        k = np.minimum(k, max(n - 1, 0))
        if n:
            np.copyto(out, k, where=vocab.take(k) == tokens)
        k += 1
    return out


def buckets_of(vocab: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Context bucket of each word (and, last, of all others): the most frequent have their own, the rest share some by hash."""
    own = PREV // 2
    out = own + (vocab % np.uint64(PREV - own - 2)).astype(np.int64)
    out[np.argsort(-count, kind="stable")[:own]] = np.arange(min(own, len(vocab)))
    return np.append(out, PREV - 2)


def previous(x: np.ndarray, border: np.ndarray, k: int, blank: int) -> np.ndarray:
    """The value k places before, ``blank`` at and beyond a document's start."""
    out = np.full_like(x, blank)
    out[k:] = x[:-k] if k < len(x) else x[:0]
    for j in range(k):
        p = border[:-1] + j
        out[p[p < border[1:]]] = blank
    return out


def feature_hashes(tokens: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Hashes of each token's context, ``FEATURES`` of them; the first is the bias. A feature's hashes lie one after another."""
    blank = np.uint64(7)
    p1, p2, p3 = (previous(tokens, border, k, blank) for k in (1, 2, 3))
    out = np.zeros((len(tokens), FEATURES), np.uint64, order="F")
    for j, h in enumerate((p1, p2 * np.uint64(3), p3 * np.uint64(5), p1 * np.uint64(7) + p2 * np.uint64(11)), 1):
        out[:, j] = mix(h)
    return out


def rows_at(hashes: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the weight table for contexts at nodes of the tree; row 0 is the root's bias."""
    out = mix(hashes + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]) >> np.uint64(64 - bits)
    out = np.maximum(out.astype(np.int64), 1)
    out[node == 0, 0] = 0
    return out


class Room:
    """Rows of digits by name that are used again, as memory that is new each time costs more than what is written there."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def rows(self, name: str, n: int) -> np.ndarray:
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty((n + n // 4, CLASSES), np.float32)
        return self.held[name][:n]


def logits(w: np.ndarray, rows: np.ndarray, start: np.ndarray, room: Room | None = None) -> np.ndarray:
    """``start`` with the weights of all features added, in place."""
    part = (room or Room()).rows("part", len(start))
    for r in rows.T:
        np.take(w, r, 0, out=part, mode="clip")
        start += part
    return start


def exps(z: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits and their sums by row. Rows whose sum would leave what a float holds are brought to a maximum of 0 first, in ``z`` too."""
    e = room.rows("exp", len(z))
    with np.errstate(over="ignore"):
        np.exp(z, out=e)
    whole = e @ np.ones(CLASSES, np.float32)
    odd = np.flatnonzero(~((whole > 1e-30) & (whole < 1e30)))
    if len(odd):
        z[odd] -= z[odd].max(1, keepdims=True)
        e[odd] = np.exp(z[odd])
        whole[odd] = e[odd].sum(1)
    return e, whole


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def steps_of(tree: Tree, hashes: np.ndarray, bits: int, at: np.ndarray, tokens: np.ndarray, before: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(token, rows of the weight table, rows of ``start``, digit) of tokens a to b: the root's steps, then those below."""
    token, node, y, row = tree.steps(at[a:b], tokens[a:b], before[a:b])
    for s, which in ((slice(b - a), range(FEATURES)), (slice(b - a, None), DEEP)):
        chosen = np.empty((len(which), len(token[s])), np.uint64)
        for k, j in enumerate(which):
            np.take(hashes[:, j], token[s] + a, out=chosen[k], mode="clip")
        yield token[s], rows_at(chosen.T, node[s], bits), row[s], y[s]


def update(w: np.ndarray, speed: np.ndarray, rows: np.ndarray, start: np.ndarray, y: np.ndarray, room: Room) -> None:
    """Adagrad on the rows of steps to the digits ``y``, a feature at a time; a row's change is between the mean and the sum of its steps'."""
    k = len(y)
    if k > 1 << PLACE:
        raise ValueError("too many steps for the place in a key")
    g, whole = exps(logits(w, rows, start, room), room)
    g *= (1 / whole)[:, None]
    g[np.arange(k), y] -= 1
    place, lump = np.arange(k, dtype=np.uint64), w.view(f"V{4 * CLASSES}").ravel()  # a row as one value, which is put faster
    for r in rows.T if k else ():
        key = r.astype(np.uint64) << np.uint64(PLACE) | place
        key.sort()
        row, o = (key >> np.uint64(PLACE)).astype(np.int64), (key & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        n = np.diff(np.append(first, k))
        if len(n) == 1:
            total = g.sum(0, keepdims=True)
        else:
            order = np.argsort(-np.minimum(n, BLOCK + 1).astype(np.int16), kind="stable")
            first, n = first[order], n[order]
            total = group_sums(g, o, first, n, room)
        which, n = row[first], n.astype(np.float32)
        speed[which] = pace = speed[which] + np.einsum("ij,ij->i", total, total) / (CLASSES * n)
        total *= (RATE / np.sqrt(pace * n))[:, None]
        now = room.rows("part", len(which))
        np.take(w, which, 0, out=now, mode="clip")
        now -= total
        lump[which] = now.view(lump.dtype).ravel()


def group_sums(g: np.ndarray, o: np.ndarray, first: np.ndarray, n: np.ndarray, room: Room) -> np.ndarray:
    """Sums of the rows ``o[first[i] : first[i] + n[i]]`` of g. Groups of more than ``BLOCK`` rows come first, the others by falling n."""
    total, part = room.rows("total", len(n)), room.rows("part", len(n))
    more = len(n) - np.cumsum(np.bincount(np.minimum(n, BLOCK + 1), minlength=BLOCK + 2))  # groups of more rows than that
    large = int(more[BLOCK])
    if large:
        total[:large] = large_sums(g, o, first[:large], n[:large])
    np.take(g, o.take(first[large:]), 0, out=total[large:], mode="clip")
    for k in range(1, BLOCK):
        end = int(more[k])
        if end == large:
            break
        np.take(g, o.take(first[large:end] + k), 0, out=part[: end - large], mode="clip")
        total[large:end] += part[: end - large]
    return total


def large_sums(g: np.ndarray, o: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same for groups of any size: ``BLOCK`` rows become one until each group has one."""
    while True:
        blocks = -(-n // BLOCK)
        begin = np.cumsum(blocks) - blocks
        place = (np.repeat(first - BLOCK * begin, blocks) + BLOCK * np.arange(blocks.sum()))[:, None] + np.arange(BLOCK)
        there = place < np.repeat(first + n, blocks)[:, None]
        got = g.take(o.take(np.where(there, place, 0).ravel()), 0)
        got[~there.ravel()] = 0
        g = got.reshape(-1, BLOCK, CLASSES).sum(1)
        if blocks.max() == 1:
            return g
        o, first, n = np.arange(len(g)), begin, blocks


def cooccurrence(docs: DataFrame, vocab: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Counts (bucket of the word before, word) over all training documents; the last word stands for all others."""
    shape = (PREV, len(vocab) + 1)

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(shape[0] * shape[1], np.int64)
        for b in batches:
            for _, tokens, border in token_pieces(_train_rows(b), 1):
                k = lookup(tokens, vocab)
                before = previous(bucket[k], border, 1, PREV - 1)
                total += np.bincount(before * shape[1] + k, minlength=len(total))
        part = TaskContext.get().partitionId()
        total = total.reshape(shape)
        for p in range(0, PREV, 8):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([p], pa.int32()), pa.array([zlib.compress(total[p : p + 8].tobytes(), 1)], pa.binary())], ["part", "block", "data"])

    got = sum_blocks(docs.select("doc_id", "text").mapInArrow(lean(run), "part int, block int, data binary"), "<i8", packed=True)
    out = np.zeros(shape, np.float64)
    for p, a in got.items():
        out[p : p + 8] = a.reshape(-1, shape[1])
    return out


def word_classes(cooc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Class of each frequent word, by k-means over what it follows; class 0 is kept for all other words."""
    x = np.sqrt(cooc[:, :-1].T / np.maximum(count, 1)[:, None]).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    k = min(CLASSES - 1, len(x))
    if not k:
        return np.zeros(0, np.int64)
    center, weight = x[np.argsort(-count, kind="stable")[:k]], np.sqrt(count)[:, None]
    for _ in range(12):
        near = (x @ center.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                center[j] = (x[near == j] * weight[near == j]).sum(0)
        center /= np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-9)
    return (x @ center.T).argmax(1) + 1


def word_table(cooc: np.ndarray, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 p(word | class, bucket before): counts of the bucket drawn towards the class's own."""
    n, prior = cooc[:, :-1], np.maximum(count, 1).astype(np.float64)
    mass = np.bincount(cls, prior, CLASSES)
    prior = prior / mass[cls]
    per = np.zeros((PREV, CLASSES))
    for c in range(CLASSES):
        per[:, c] = n[:, cls == c].sum(1)
    pull = 100.0
    return np.log10((n + pull * prior) / (per[:, cls] + pull)).astype(np.float32)


def leaves(tokens: np.ndarray, digits: int) -> np.ndarray:
    """Leaf of each word that is not frequent: the upper digits of its hash."""
    return (mix(tokens) >> np.uint64(64 - DIGIT * digits)).astype(np.int64)


def rest_mass(counts: DataFrame, vocab: np.ndarray, digits: int) -> np.ndarray:
    """Counts plus kinds of the words beyond ``vocab`` in each leaf, and one unit for its unseen words."""
    size = 1 << (DIGIT * digits)

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, h, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                rare = lookup(h, vocab) == len(vocab)
                total += np.bincount(leaves(h[rare], digits), c[rare] + 1, size).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    out = np.ones(size, np.int64)
    for r in counts.mapInArrow(lean(run), "data binary").toLocalIterator():
        out += np.frombuffer(r["data"], np.int64)
    return out


class Tree:
    """Steps from the root to each word: nodes, digits, and the logits that a step starts from."""

    def __init__(self, cls: np.ndarray, count: np.ndarray, words: np.ndarray, mass: np.ndarray):
        n = len(cls)
        self.of, self.size, self.mass = np.append(cls, 0), n, mass
        self.digits = (len(mass).bit_length() - 1) // DIGIT
        depth = max(1, math.ceil(math.log(max(n, 2), CLASSES)))
        self.node, self.digit = np.full((n, depth), -1), np.zeros((n, depth), np.int64)
        inner = 1
        for c in range(1, CLASSES):
            at = np.flatnonzero(cls == c)
            at = at[np.argsort(-count[at], kind="stable")]
            steps = next(d for d in range(depth + 1) if CLASSES**d >= len(at))
            rank = np.arange(len(at))
            for d in range(steps):
                above, place = np.divmod(rank // CLASSES ** (steps - 1 - d), CLASSES)
                self.node[at, d], self.digit[at, d] = inner + above, place
                inner += int(above.max()) + 1
        self.inner = inner
        start = np.full((inner, PREV, CLASSES), -1e4, np.float32)
        start[0] = 0
        used = self.node >= 0
        key = (self.node * CLASSES + self.digit)[used]
        for p in range(PREV if len(key) else 0):
            share = np.repeat(10.0 ** words[p].astype(float), used.sum(1))
            got = np.bincount(key, share, inner * CLASSES).reshape(inner, CLASSES)
            whole = got.sum(1, keepdims=True)
            got = np.divide(got, whole, out=np.zeros_like(got), where=whole > 0)
            start[:, p][got > 0] = np.log(got[got > 0])
        rest = []
        for d in range(self.digits):
            m = mass.reshape(CLASSES**d, CLASSES, -1).sum(2)
            rest.append(np.log(m / m.sum(1, keepdims=True)))
        self.start = np.concatenate([start.reshape(-1, CLASSES), *rest]).astype(np.float32)

    def steps(self, at: np.ndarray, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, node, digit, row of ``start``) of every step to the tokens; ``at`` is their place among the frequent words."""
        token, node, digit, row = [np.arange(len(at))], [np.zeros(len(at), np.int64)], [self.of[at]], [before]
        usual, rare = np.flatnonzero(at < self.size), np.flatnonzero(at == self.size)
        for d in range(self.node.shape[1]):
            k = usual[self.node[at[usual], d] >= 0]
            node.append(self.node[at[k], d])
            token.append(k)
            digit.append(self.digit[at[k], d])
            row.append(node[-1] * PREV + before[k])
        leaf, base = leaves(tokens[rare], self.digits), 0
        for d in range(self.digits):
            above, place = np.divmod(leaf >> (DIGIT * (self.digits - 1 - d)), CLASSES)
            token.append(rare)
            node.append(self.inner + base + above)
            digit.append(place % CLASSES)
            row.append(self.inner * PREV + base + above)
            base += CLASSES**d
        return tuple(np.concatenate(x) for x in (token, node, digit, row))


def row_bits(total: int) -> int:
    """Bits of the weight table's rows: about a row for 16 tokens up to ``DENSE_ROW_BITS``; from there a row for 256, so that what the
    tasks send of it takes no more disk by the token however many there are; as far as memory goes."""
    dense = min((total // 16).bit_length(), DENSE_ROW_BITS)
    return min(max(dense, (total // 256).bit_length(), ROW_BITS), MOST_ROW_BITS)


def train(docs: DataFrame, vocab: np.ndarray, bucket: np.ndarray, tree: Tree, root: np.ndarray, bits: int) -> np.ndarray:
    """Weights (row, digit) after all rounds. A task for each core: each sends its changes of the whole table."""
    sc = docs.sparkSession.sparkContext
    w = np.zeros((1 << bits, CLASSES), np.float32)
    w[0] = root
    step = 1 << 10  # rows of a block
    tasks = max(sc.defaultParallelism, 1)
    docs = docs.select("doc_id", "text").coalesce(tasks)
    fixed = sc.broadcast((vocab, bucket, tree))
    for round_ in range(ROUNDS):
        sent = sc.broadcast(w)

        def run(batches, round_=round_, sent=sent):
            from pyspark import TaskContext

            vocab, bucket, tree = fixed.value
            w0 = sent.value
            w, seen, held, room = w0.copy(), np.zeros(len(w0), np.int64), [], Room()
            speed = np.full(len(w0), 1.0, np.float32)

            def count() -> None:
                nonlocal seen
                seen += np.bincount(np.concatenate(held), minlength=len(seen))
                held.clear()

            for b in batches:
                for _, tokens, border in token_pieces(_train_rows(b, round_), 1):
                    at, hashes = lookup(tokens, vocab), feature_hashes(tokens, border)
                    before = previous(bucket[at], border, 1, PREV - 1)
                    for i in range(0, len(tokens), STEP):
                        for _, rows, row, y in steps_of(tree, hashes, bits, at, tokens, before, i, min(i + STEP, len(tokens))):
                            start = room.rows("start", len(y))
                            np.take(tree.start, row, 0, out=start, mode="clip")
                            update(w, speed, rows, start, y, room)
                            held += list(rows.T)
                        if len(held) > 100:
                            count()
            if held:
                count()
            part = TaskContext.get().partitionId()
            for k in range(0, len(w), step):
                n = seen[k : k + step, None]
                if n.any():
                    change = (w[k : k + step] - w0[k : k + step]).astype("<f2")
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([change.tobytes() + n.astype("<f4").tobytes()], pa.binary())], ["part", "block", "data"])

        def weighted(raw: bytes) -> np.ndarray:
            n = np.frombuffer(raw[step * CLASSES * 2 :], "<f4")[:, None]
            return np.concatenate([np.frombuffer(raw[: step * CLASSES * 2], "<f2").reshape(-1, CLASSES) * n, n], 1).ravel()

        changes = stored(block_sums(docs.mapInArrow(lean(run), "part int, block int, data binary"), "<f4", read=weighted, tasks=tasks), "changes")
        sent.destroy()  # the driver's copy too
        for r in changes.toLocalIterator():  # the driver holds the table once, and a few blocks
            a, k = np.frombuffer(r["data"], "<f4").reshape(-1, CLASSES + 1), r["block"]
            w[k : k + step] += a[:, :-1] / np.maximum(a[:, -1:], 1)
        discard(changes)
    fixed.destroy()
    give_back()
    return w


OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = count_tokens(docs)
    vocab, count, total, kinds = frequent(counts)
    bucket = buckets_of(vocab, count)
    cooc = cooccurrence(docs, vocab, bucket)
    cls = word_classes(cooc, count)
    words = word_table(cooc, count, cls)
    of = np.append(cls, 0)
    mass = np.bincount(of, np.append(count, total - count.sum() + 1), CLASSES)
    digits = next((d for d in range(1, MOST_DIGITS) if 1024 * CLASSES**d >= kinds), MOST_DIGITS)
    tree, bits = Tree(cls, count, words, rest_mass(counts, vocab, digits)), row_bits(total)
    w = train(docs, vocab, bucket, tree, np.log((mass + 1) / (mass + 1).sum()).astype(np.float32), bits)

    buckets = max(shuffle_parts(spark), 12)
    base_norm = math.log10(total + kinds + 1)
    top_log = np.log10(count + 1.0)
    model = spark.sparkContext.broadcast((w, tree))  # of bounded size

    def send(batches):
        from pyspark import TaskContext

        w, tree = model.value
        leaf_log, room = np.log10(tree.mass), Room()
        part, k = TaskContext.get().partitionId(), 0
        names = ["uid", "bucket", "a", "b", "c", "d", "e"]
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        for b in batches:
            rows, held = b.column(0).cast(pa.int64()), 0
            for docs_, tokens, border in token_pieces(b, 1):
                n = len(docs_)
                at = lookup(tokens, vocab)
                doc = np.repeat(np.arange(n), np.diff(border))
                usual = at < len(vocab)
                lp = np.zeros(len(tokens), np.float64)
                hashes, before = feature_hashes(tokens, border), previous(bucket[at], border, 1, PREV - 1)
                for i in range(0, len(tokens), STEP):
                    j = min(i + STEP, len(tokens))
                    for token, r, row, y in steps_of(tree, hashes, bits, at, tokens, before, i, j):
                        z = room.rows("start", len(y))
                        np.take(tree.start, row, 0, out=z, mode="clip")
                        _, whole = exps(logits(w, r, z, room), room)
                        got = z[np.arange(len(y)), y] - np.log(whole)
                        lp[i:j] += np.bincount(token, got, j - i)
                lp /= math.log(10)
                lp[~usual] -= leaf_log[leaves(tokens[~usual], tree.digits)]
                score = np.bincount(doc, lp, n)
                base = np.bincount(doc[usual], top_log[at[usual]], n)
                known = np.bincount(doc[usual], minlength=n)
                uid = (part << 32) + k
                k += 1
                ids = rows.slice(int(docs_[0]), n)
                raw_ids = ids.fill_null(0).to_numpy().tobytes() + np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()
                out = [(uid, None, raw_ids, np.diff(border).tobytes(), known.astype(np.int64).tobytes(), base.tobytes(), score.tobytes())]
                h, d = tokens[~usual], doc[~usual]
                to = (h % np.uint64(buckets)).astype(np.int64)
                o = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[o], np.arange(buckets + 1))
                out += [(uid, q, h[o[i:j]].tobytes(), d[o[i:j]].astype(np.int32).tobytes(), None, None, None) for q, i, j in zip(range(buckets), cut, cut[1:], strict=False) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    sent = stored(docs.mapInArrow(lean(send), "uid long, bucket int, a binary, b binary, c binary, d binary, e binary"), "scored")
    model.destroy()  # the pass that needs it has run
    give_back()

    def find(batches):
        table, asked = {}, {}
        for b in batches:
            for q, uid, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if uid is None:
                    table[q] = (np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64))
                else:
                    asked.setdefault(q, []).append((uid, x, y))
        for q, parts in asked.items():
            h, c = table.get(q, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            for uid, x, y in parts:
                at, d = lookup(np.frombuffer(x, np.uint64), h), np.frombuffer(y, np.int32)
                n = np.append(c, 0)[at]
                doc, inverse = np.unique(d, return_inverse=True)
                logs, known = np.bincount(inverse, np.log10(n + 1.0)), np.bincount(inverse, n > 0)
                yield pa.RecordBatch.from_arrays([pa.array([uid]), *(pa.array([v.tobytes()], pa.binary()) for v in (doc.astype(np.int32), logs, known.astype(np.int64)))], ["uid", "a", "b", "c"])

    rare = sent.filter("bucket IS NOT NULL").select("bucket", "uid", F.col("a").alias("x"), F.col("b").alias("y"))
    known = counts.select("bucket", F.lit(None).cast("long").alias("uid"), F.col("h").alias("x"), F.col("c").alias("y"))
    found = rare.unionByName(known).repartition(buckets, "bucket").mapInArrow(lean(find), "uid long, a binary, b binary, c binary")

    def join(batches):
        base, more = {}, {}
        for b in batches:
            for uid, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if raw[3] is None:
                    more.setdefault(uid, []).append(raw)
                else:
                    base[uid] = raw
        for uid, (ids, size, known, logs, score) in base.items():
            size, known, logs, score = np.frombuffer(size, np.int64), np.frombuffer(known, np.int64).copy(), np.frombuffer(logs).copy(), np.frombuffer(score).copy()
            n = len(size)
            none = np.unpackbits(np.frombuffer(ids[8 * n :], np.uint8))[:n].astype(bool)
            for d, x, y, *_ in more.pop(uid, []):
                d, x, y = np.frombuffer(d, np.int32), np.frombuffer(x), np.frombuffer(y, np.int64)
                logs[d] += x
                score[d] += x
                known[d] += y
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids[: 8 * n], np.int64), mask=none), pa.array(size), pa.array(known), pa.array(np.full(n, total)), pa.array(logs - size * base_norm), pa.array(score)], [x.split()[0] for x in OUT.split(", ")])

    full = sent.filter("bucket IS NULL").select("uid", "a", "b", "c", "d", "e")
    found = found.select("uid", "a", "b", "c", F.lit(None).cast("binary").alias("d"), F.lit(None).cast("binary").alias("e"))
    out = full.unionByName(found).repartition(buckets, "uid").mapInArrow(lean(join), OUT)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    return out.withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
