"""N-gram Jaccard join by adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles, ordered by estimated frequency (a table of fixed size, counted over all
documents), rare ones first. The l-prefix is the first |x| - ceil(t |x|) + l shingles; a pair at or above threshold t shares at
least min(l_x, l_y) shingles of its prefixes. Each document takes the l that makes its postings and its expected
candidates (the prefix's excess frequencies over l) cheapest, so documents of frequent shingles need more matches. A bucket of the
table counts many shingles; only what stands out of that noise (``NOISE`` deviations above the middle bucket) is excess.

Documents with equal sets are one node, known by a 64-bit fingerprint. A first round verifies each node against one hub,
the node with which it shares most prefix shingles; a second verifies all further candidates whose nodes are not yet in one
component. Links inside a component change nothing, so no link between different texts is lost for the classes. Nodes that frequent
tokens connect are compared in blocks, so a group of near copies is not expanded into its pairs.

Nulls and empty texts: empty set, linked with nothing, its component is its own doc_id. Texts under five words: the whole
sequence is one shingle. Repeated rows of a doc_id each get a row. A null doc_id never names a component, unless no other
member does. Empty tables give no rows; extra columns are ignored. Long texts: whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, sum_blocks
from .shared import discard, lean, shuffle_parts, stored
from .text import mix, pieces, shingle_sets, utf8, word_hashes

WORDS, PERCENT = 5, 75
COUNT_BITS, BLOCK = 22, 1 << 15
MATCHES = (1, 2, 4, 8, 12, 16, 24, 32)
#: The filter of wanted documents: bits for one of them, its least and largest size as powers of two (the largest is 32 MB), bytes of a block.
BLOOM_SHARE, BLOOM_LEAST, BLOOM_MOST, BLOOM_PROBES, BLOOM_BLOCK = 16, 20, 28, 3, 1 << 17
NOISE = 3.0
#: A token of more open nodes than this is hot; hot nodes are compared in blocks of so many.
HOT, BLOCK_NODES = 64, 512
#: Cost of a posting and of a candidate, in the same unit.
POSTING_COST, CANDIDATE_COST = 1.0, 4.0


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64))[0].view(np.int64)) if len(s) else 0


def doc_sets(batch: pa.RecordBatch, text: int, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of each row of a batch."""
    data, off = utf8(batch.column(text))
    for a, b in pieces(off):
        o = off[a : b + 1] - off[a]
        w, woff = word_hashes(data[off[a] : off[b]], o)
        for k, s in enumerate(shingle_sets(w, woff, words)):
            yield a + k, s


def packed48(x: np.ndarray) -> bytes:
    """The lower six bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def bytes_of(x: np.ndarray) -> bytes:
    return x.tobytes()


def short_sizes(n: np.ndarray) -> bytes:
    return (n.astype(np.uint16) if n.max(initial=0) < 1 << 16 else n.astype(np.int32)).tobytes()


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def profile(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Stored: a row for each document (doc_id, n, fp), and each task's shingle counts in blocks (part, block, data)."""

    def run(batches):
        from pyspark import TaskContext

        counts, part = np.zeros(1 << COUNT_BITS, np.int64), TaskContext.get().partitionId()
        names = ["doc_id", "n", "fp", "part", "block", "data"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            n, fp, held, size = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64), [], 0
            for i, s in doc_sets(b, 1, words):
                n[i], fp[i] = len(s), fingerprint(s)
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    np.add.at(counts, (np.concatenate(held) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
                    held, size = [], 0
            if held:
                np.add.at(counts, (np.concatenate(held) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
            none = [None] * len(b)
            cols = [b.column(0).cast(pa.int64()), n, fp, none, none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        k = len(counts) // BLOCK
        none = [None] * k
        cols = [none, none, none, [part] * k, list(range(k)), [zlib.compress(counts[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in range(k)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return stored(docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, fp long, part int, block int, data binary"), "profile")


def choose_matches(order: np.ndarray, excess: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, prefix length) of a set whose shingles' excess frequencies are given in prefix order."""
    n = len(order)
    need = int(_needed(n, percent))
    best = None
    for l in MATCHES:  # noqa: E741
        p = n - need + l
        if l > need:
            break
        cost = POSTING_COST * p + CANDIDATE_COST * float(excess[:p].sum()) / l
        if best is None or cost < best[0]:
            best = (cost, l, p)
    return best[1], best[2]


def shared_postings(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """Stored: prefix postings (token, fp, n, l) of tokens that two nodes or more have, and hub pairs (a, b, shared).

    Postings travel as a few rows of packed arrays for each bucket of tokens; a node is sent once for each batch. Of a token go the upper
    48 bits, beside those that its bucket tells: tokens that agree there by chance only make a candidate more. A size goes as 16 bits
    where all of a row fit.
    """
    spark = docs.sparkSession
    buckets = max(shuffle_parts(spark), 12)  # few, so that a node has several tokens in one and packs well
    usual = float(np.median(counts))
    usual = int(usual + NOISE * np.sqrt(usual))
    known = spark.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))  # 16 MB, of fixed size

    def send(batches):
        cnt = known.value
        for b in batches:
            tok, fps, ns, ls, seen = [], [], [], [], set()
            for _, s in doc_sets(b, 0, words):
                if not len(s) or (fp := fingerprint(s)) in seen:
                    continue
                seen.add(fp)
                c = cnt[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                order = np.argsort(c, kind="stable")  # ties: by hash, the sets are sorted
                l, p = choose_matches(order, np.maximum(c[order].astype(np.int64) - usual, 0), percent)  # noqa: E741
                tok.append(s[order[:p]])
                fps.append((fp, p))
                ns.append(len(s))
                ls.append(l)
            if not tok:
                continue
            p = [x[1] for x in fps]
            t = np.concatenate(tok)
            f = np.repeat(np.array([x[0] for x in fps], np.int64), p)
            n = np.repeat(np.array(ns, np.int32), p)
            m = np.repeat(np.array(ls, np.int8), p)
            to = (t % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[o], np.arange(buckets + 1))
            t, f, n, m = t[o], f[o], n[o], m[o]
            for k0 in range(0, buckets, 64):  # bounded record batches
                rows = [(k, cut[k], cut[k + 1]) for k in range(k0, min(k0 + 64, buckets)) if cut[k] < cut[k + 1]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([pack(x[i:j]) for _, i, j in rows], pa.binary()) for x, pack in ((t >> np.uint64(16), packed48), (f, bytes_of), (n, short_sizes), (m, bytes_of)))], ["bucket", "t", "f", "n", "l"])

    def meet(batches):
        by: dict[int, list] = {}
        for b in batches:
            for bucket, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by.setdefault(bucket, []).append(raw)
        for bucket, raws in by.items():
            t, f, l = (np.concatenate([read(r[k]) for r in raws]) for k, read in ((0, unpacked48), (1, lambda x: np.frombuffer(x, np.int64)), (3, lambda x: np.frombuffer(x, np.int8))))  # noqa: E741
            n = np.concatenate([np.frombuffer(r[2], np.uint16 if len(r[2]) == 2 * len(r[3]) else np.int32).astype(np.int32) for r in raws])
            raws.clear()
            t = t << np.uint64(16) | np.uint64(bucket & 0xFFFF)  # one number for one token in whatever bucket
            o = np.lexsort((f, t))
            t, f, n, l = t[o], f[o], n[o], l[o]  # noqa: E741
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
            t, f, n, l = t[keep], f[keep], n[keep], l[keep]  # noqa: E741
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.append(first, len(t)))
            many = np.repeat(size > 1, size)
            t, f, n, l = t[many], f[many], n[many], l[many]  # noqa: E741
            if not len(t):
                continue
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            lead = np.repeat(at, np.diff(np.append(at, len(t))))
            a, b2, na, least = f[lead], f, n[lead], np.minimum(l[lead], l)
            ok = (a != b2) & (100 * np.minimum(na, n).astype(np.int64) >= percent * np.maximum(na, n).astype(np.int64))
            pairs = np.stack([a[ok], b2[ok], least[ok].astype(np.int64)], 1)
            if len(pairs):
                po = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[po]
                new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)]))
                shared = np.diff(np.append(new, len(pairs)))
                pairs = pairs[new]
            else:
                shared = np.zeros(0, np.int64)
            blank = lambda k: pa.nulls(k, pa.int64())
            names = ["token", "fp", "n", "l", "a", "b", "shared"]
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(f), pa.array(n.astype(np.int64)), pa.array(l.astype(np.int64)), blank(len(t)), blank(len(t)), blank(len(t))], names)
            if len(pairs):
                k = len(pairs)
                yield pa.RecordBatch.from_arrays([blank(k), blank(k), blank(k), pa.array(pairs[:, 2]), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(shared.astype(np.int64))], names)

    sent = docs.select("text").mapInArrow(lean(send), "bucket int, t binary, f binary, n binary, l binary")
    met = sent.repartition(buckets, "bucket").mapInArrow(lean(meet), "token long, fp long, n long, l long, a long, b long, shared long")
    return stored(met, "postings")


def _probes(fp: np.ndarray, doc_id: np.ndarray, bits: int) -> np.ndarray:
    h = mix(fp.view(np.uint64) ^ mix(doc_id.astype(np.int64).view(np.uint64)))
    return np.stack([mix(h + np.uint64(k)) >> np.uint64(64 - bits) for k in range(BLOOM_PROBES)], 1).astype(np.int64)


def wanted_filter(nodes: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a Bloom filter of the nodes' (fp, doc_id)."""

    def fill(batches):
        from pyspark import TaskContext

        raw, part = np.zeros((1 << bits) // 8, np.uint8), TaskContext.get().partitionId()
        for b in batches:
            p = np.unique(_probes(*(c.to_numpy(zero_copy_only=False) for c in b.columns), bits))
            np.bitwise_or.at(raw, p >> 3, (1 << (p & 7)).astype(np.uint8))
        for k in range(0, len(raw), BLOOM_BLOCK):
            if raw[k : k + BLOOM_BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k // BLOOM_BLOCK], pa.int32()), pa.array([raw[k : k + BLOOM_BLOCK].tobytes()], pa.binary())], ["part", "block", "data"])

    raw = np.zeros((1 << bits) // 8, np.uint8)
    for k, a in sum_blocks(nodes.select("fp", "doc_id").mapInArrow(lean(fill), "part int, block int, data binary"), "u1", add_up=np.bitwise_or).items():
        raw[k * BLOOM_BLOCK : (k + 1) * BLOOM_BLOCK] = a
    return raw


def node_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Stored: the sets of ``nodes`` (fp, doc_id of one document that has it), and of a few more: the upper 48 bits of each shingle's hash.

    Two shingles of a pair of sets agree there by chance once in 2^48 / (n * n) pairs, and then the overlap is one too high.

    Texts are not shuffled: a Bloom filter, its size counted, tells each task which documents it needs; the joins that use the sets
    drop the few others. Of more nodes than the largest filter is for, all sets go by their fingerprints to the nodes.
    """
    asked = nodes.filter("doc_id IS NOT NULL")
    count = asked.count()
    bits = max(BLOOM_LEAST, (BLOOM_SHARE * count).bit_length())
    sent = docs.sparkSession.sparkContext.broadcast(wanted_filter(asked, bits)) if bits <= BLOOM_MOST else None

    def run(batches):
        raw = None if sent is None else sent.value
        for b in batches:
            ids, fps, sets, held = b.column(1).cast(pa.int64()).to_pylist(), [], [], 0
            for i, s in doc_sets(b, 0, words):
                if not len(s):
                    continue
                fp = fingerprint(s)
                if raw is not None and ids[i] is not None:
                    p = _probes(np.array([fp]), np.array([ids[i]]), bits).ravel()
                    if not (raw[p >> 3] >> (p & 7) & 1).all():
                        continue
                fps.append(fp)
                sets.append(packed48(s >> np.uint64(16)))
                held += len(sets[-1])
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], ["fp", "s"])
                    fps, sets, held = [], [], 0
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], ["fp", "s"])

    sets = docs.select("text", "doc_id").mapInArrow(lean(run), "fp long, s binary")
    return stored(sets if sent is not None else sets.join(nodes.select("fp"), "fp", "left_semi"), "nodesets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored: the pairs (a, b) at or above the threshold."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = unpacked48(x), unpacked48(y)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    other = pairs.select("a", "b").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    full = other.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")
    return stored(full.mapInArrow(lean(run), "a long, b long"), "links")


def cold_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share enough prefix tokens.

    x's prefix leaves need_x - l_x tokens. All common tokens up to the end of the prefix that ends first are in both, so a
    pair with the overlap that the threshold asks of its sizes shares that much less what is left behind, and l at least. ``h``: how
    many hot tokens, which are not counted here, a node's prefix has.
    """
    x, y = rest.alias("x"), rest.alias("y")
    meets = (F.col("x.token") == F.col("y.token")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.comp") != F.col("y.comp"))
    meets &= 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    behind = lambda s: F.floor((percent * F.col(f"{s}.n") + 99) / 100) - F.col(f"{s}.l")
    overlap = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    asked = F.greatest(F.least("x.l", "y.l"), overlap - F.greatest(behind("x"), behind("y"))) - F.least("x.h", "y.h")
    pairs = x.join(y, meets).groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).agg(F.count("*").alias("shared"), F.min(asked).alias("asked"))
    return pairs.filter("shared >= asked").select("a", "b")


def hot_links(hot: DataFrame, fetch, percent: int) -> DataFrame:
    """Stored: links (a, b) among nodes that share hot tokens, as many as tell the components.

    Nodes that hot tokens connect are a cluster; its nodes are dealt to blocks, and each two blocks are compared by one task as a
    product of incidence matrices. No pair is a row: a task gives one link for each node at most.
    """
    cluster = components(hot.select(F.col("fp").alias("u"), F.col("token").alias("v")))
    node = hot.select("fp").distinct().join(cluster.select(F.col("u").alias("fp"), F.col("v").alias("c")), "fp", "left").select("fp", F.coalesce("c", "fp").alias("c"))
    blocks = node.groupBy("c").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("long").alias("blocks"))
    dealt = node.join(blocks, "c").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("fp", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("fp")
        fp, sets = pdf["fp"].to_numpy(np.int64), [unpacked48(s) for s in pdf["s"]]
        size = np.array([len(s) for s in sets], np.float32)
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size.astype(int))
        keep = df[column] > 1
        row, column = row[keep], (np.cumsum(df > 1) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[a:b], column[a:b] - low] = 1
            both += m @ m.T
        near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(near, True)
        label = np.arange(len(sets))
        while True:
            least = np.where(near, label[None, :], len(sets)).min(1)
            if (least == label).all():
                break
            label = least
        moved = label != np.arange(len(sets))
        return pd.DataFrame({"a": fp[label[moved]], "b": fp[moved]})

    sets = fetch(node.select("fp"))
    out = stored(dealt.join(sets, "fp").groupBy("c", "i", "j").applyInPandas(compare, "a long, b long"), "hotlinks")
    discard(sets, cluster)
    return out


def near_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (least doc_id that its links reach)."""
    seen = profile(docs, words)
    rows = seen.filter("block IS NULL").select("doc_id", "n", "fp")
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for k, a in sum_blocks(seen.filter("block IS NOT NULL").select("part", "block", "data"), "<i8", packed=True).items():
        counts[k * BLOCK : (k + 1) * BLOCK] = a
    met = shared_postings(docs, counts, words, percent)
    postings = met.filter("token IS NOT NULL").select("token", "fp", "n", "l")
    nodes = rows.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))

    def check(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
        sets = node_sets(docs, nodes.join(ends, "fp"), words)
        out = verified(pairs, sets, percent)
        discard(sets)
        return out

    hubs = met.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("l").alias("l")).filter("shared >= l")
    tried = stored(hubs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), "tried")
    links = check(tried)
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    named = postings.join(comp.select(F.col("u").alias("fp"), F.col("v").alias("comp")), "fp", "left")
    named = stored(named.select("token", "fp", "n", "l", F.coalesce("comp", "fp").alias("comp")), "named")
    discard(met, comp)
    open_ = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo <> hi")
    rest = stored(named.join(open_.select("token", (F.col("k") > HOT).alias("hot")), "token"), "open")
    discard(named)
    hot = rest.filter("hot")
    cold = rest.filter("NOT hot").join(hot.groupBy("fp").agg(F.count("*").alias("h")), "fp", "left").fillna(0, ["h"])
    new = stored(cold_pairs(cold, percent).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    more = check(new)
    if hot.limit(1).count():
        more = more.union(hot_links(hot, lambda ends: node_sets(docs, nodes.join(ends, "fp"), words), percent))
    discard(tried, new, rest)
    links = links.union(more)
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    at = nodes.join(comp.select(F.col("u").alias("fp"), F.col("v").alias("comp")), "fp", "left").select("fp", "doc_id", F.coalesce("comp", "fp").alias("comp"))
    least = at.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = at.join(least, "comp").select("fp", "component_id")
    full = rows.filter("n > 0").join(named, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
