"""Each operator against a brute-force version, over rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from utterloom.llm import decontam, maxent, media, nearjoin, packing, quality, suffix, toxicity, urls, warc
from utterloom.llm.queries import tokenizer_path
from utterloom.llm.text import utf8


def split(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


def by_id(rows, key="doc_id"):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) if not isinstance(x, list) else x for x in r])


# --- near duplicates


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
                up[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [(i, len(s), min(least[find(k)], default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_classes(docs, none, rows):
    assert by_id(nearjoin.near_classes(docs).collect()) == by_id(brute_classes(rows))
    assert nearjoin.near_classes(none).collect() == []


def test_a_group_of_near_copies_is_one_class(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(n, " ".join(base[:n] + ["x"] + base[n + 1 :])) for n in range(60)] + [(100, " ".join(base))]
    got = nearjoin.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_id(got) == by_id(brute_classes(rows))


# --- suffix arrays


def brute_removed(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if (w := b[s : s + 100]) in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((rows[k][0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes(spark, docs, none, rows):
    clear = {i: t for i, t in rows if i is not None}  # one row for each id: the order is fixed
    got = suffix.digest(spark.createDataFrame(list(clear.items()), "doc_id long, text string"))
    assert by_id(got.collect()) == by_id(brute_removed(list(clear.items())))
    assert suffix.digest(none).collect() == []
    # repeated ids: the order among them is open, the totals are not
    assert sum(r["n_removed"] for r in suffix.digest(docs).collect()) == sum(r[2] for r in brute_removed(rows))
    kept = suffix.dedup_texts(docs)
    assert kept.columns == docs.columns


def test_column_index_is_the_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(20):
        docs = [rng.integers(0, 3, rng.integers(0, 9)) for _ in range(12)]
        start, sym = np.append(0, np.cumsum([len(d) for d in docs])), np.concatenate(docs)
        x = suffix.ColumnIndex(sym, start, 3).build()
        suf = [tuple(sym[p : start[np.searchsorted(start, p, "right")]]) for p in x.suffix]
        assert suf == sorted(suf) and sorted(x.suffix) == list(range(len(sym)))
        common = [0] + [min(3, next((k for k, (a, b) in enumerate(zip(s, t, strict=False)) if a != b), min(len(s), len(t)))) for s, t in zip(suf, suf[1:], strict=False)]
        assert x.lcp.tolist() == common
        assert x.bwt.tolist() == [int(sym[p - 1]) if p not in start else -1 for p in x.suffix]


def test_groups_of_windows_equal_brute_force(monkeypatch):
    """Whatever the size of a collection: one hash may go on over many of them."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2, 300).astype(np.uint8)
    for chunk, held in ((3, 1 << 22), (50, 40), (1 << 16, 1 << 22)):
        monkeypatch.setattr(suffix, "CHUNK", chunk)
        monkeypatch.setattr(suffix, "HELD", held)
        segs = []
        for _ in range(25):
            n, a = int(rng.integers(1, 86)), int(rng.integers(0, 8))
            x = base[a : a + n + 99].copy()
            if rng.random() < 0.7:
                x[rng.integers(0, len(x))] ^= 1
            segs.append(x)
        rid, pos = rng.integers(0, 6, 25), rng.permutation(25) * 1000
        count = np.array([len(x) - 99 for x in segs])
        s, w = suffix.repeats_of_groups(np.concatenate(segs), np.append(0, np.cumsum([len(x) for x in segs])), count, rid, pos, np.full(25, 7, np.uint64))
        seen, want = set(), []
        for _, _, k, o in sorted((rid[k], pos[k] + o, k, o) for k in range(25) for o in range(count[k])):
            if (x := segs[k][o : o + 100].tobytes()) in seen:
                want.append((k, o))
            seen.add(x)
        assert sorted(zip(s.tolist(), w.tolist(), strict=True)) == sorted(want) and want


def test_a_common_phrase_is_no_reason_to_compare_bytes(spark):
    """Documents that share 40 bytes share minimizers, but no window; those that share 90 bytes or more are compared, in groups of their own."""
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ijklmnop") for _ in range(n))
    phrase = text(40)
    apart = [(k, f"{text(90)}{phrase}{text(90)}") for k in range(400)]
    settled = suffix.settle_equal_segments(spark.createDataFrame(apart, "rid long, text string"))
    assert settled.filter(f"{settled.columns[-1]} IS NOT NULL").count() == 0
    long = [text(90), text(99), text(100), text(130)]
    rows = apart + [(1000 + k, f"{text(k % 7)}{long[k % 4]}{text(60)}") for k in range(120)]
    assert by_id(suffix.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == by_id(brute_removed(rows))


# --- decontamination


def test_leaks(spark, none):
    item = " ".join(f"w{k}" for k in range(40))
    edited = item.split()
    edited[5], edited[20], edited[30] = "a", "b", "c"
    noise = " ".join(f"n{k}" for k in range(300))
    docs = spark.createDataFrame([(1, f"{noise} {item.upper()}! {noise}"), (2, noise + " " + " ".join(edited)), (3, noise), (4, None), (5, ""), (None, item), (6, "tiny one")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "tiny one"), (9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7), (6, 8)}
    assert got[1, 7]["score"] == 1.0 and (got[1, 7]["first_word"], got[1, 7]["end_word"]) == (300, 340)
    assert got[2, 7]["score"] == pytest.approx((37 * 2 - 3) / 80)
    assert sorted(r["doc_id"] or 0 for r in decontam.without_leaks(docs, items).collect()) == [3, 4, 5]
    assert decontam.contaminated(none, items).collect() == [] and decontam.contaminated(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("verbatim", [False, True])
def test_edited_and_half_copies_are_leaks(spark, verbatim):
    r = random.Random(5)
    items = [[f"w{r.randrange(3000)}" for _ in range(n)] for n in (15, 22, 31, 40, 59)]
    noise = [f"n{k}" for k in range(80)]
    docs, want = [(-1, " ".join(noise))], set()
    for k, x in enumerate(items):
        copies = [[f"e{i}" if i % 5 == 4 else w for i, w in enumerate(x)], x[: (len(x) + 1) // 2], x[len(x) // 2 :]] + [x] * verbatim
        for c in copies:
            want.add((len(docs), k))
            docs.append((len(docs), " ".join(noise + c + noise)))
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_case_of_any_letter_hides_nothing(spark):
    item = "Élan straße ΟΔΟΣ ЖУРНАЛ état"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "élan straße οδος журнал ÉTAT"), (2, "élan οδός")], "doc_id long, text string")
    assert [(r["doc_id"], r["score"]) for r in decontam.contaminated(docs, table).collect()] == [(1, 1.0)]


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 14)
        h = np.zeros((10, 15), int)
        for i in range(9):
            for j in range(14):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b)[0] == h.max()


# --- packing


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), 64).collect()
    want = Counter()
    for i, t in rows:
        want[i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    starts = Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    assert starts == want
    fill = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for s, o, n in fill:
        assert s * 64 + o == at and o + n <= 64
        at += n
    assert at == sum(n * k for (_, n), k in want.items())
    ids = {i: np.append(tok.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4") for i, t in rows if i in (10, 11, 12)}
    for r in got:
        if r["doc_id"] in ids:
            assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert packing.pack(none, tokenizer_path()).collect() == []


# --- media


def test_media(docs, none, rows):
    got = media.store_texts(docs).collect()
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert all(r["clips"][0]["start_s"] == 0.0 for r in got) and media.clip_rows(none).collect() == []


def test_frames_with_any_tables():
    p = bytes(range(256))
    avi = media.encode(p)
    at, n = media.parse_avi(avi)["frames"][0]
    blocks, _, dc, ac, *_, start = media._read_head(avi[at : at + n])
    scan = avi[at + start : at + n - 2].replace(b"\xff\x00", b"\xff")
    assert media.payload_of(media._slow_scan(scan, blocks, dc, ac)) == p
    with pytest.raises(ValueError):
        media.parse_avi(b"RIFF0000WAVE")
    hist = np.repeat(np.eye(32)[[0, 5]], 6, axis=0)
    assert media.cuts(hist) == [6]


# --- language model


def test_language_model(docs, none, rows):
    got = maxent.score_documents(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, [*split(t), None]) for i, t in rows]
    c = Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i is not None, i or 0, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks]
    found = [(r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got]
    for a, b in zip(sorted(found), sorted(want), strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1])
    assert all(r["score"] < 0 for r in got) and maxent.score_documents(none).collect() == []


def test_the_model_is_a_distribution():
    """Class and word probabilities sum to 1 over all words of a context."""
    count = np.array([5, 3, 2, 9])
    cooc = np.ones((maxent.PREV, 5))
    cls = maxent.word_classes(cooc, count)
    table = 10 ** maxent.word_table(cooc, count, cls).astype(float)
    for k in set(cls.tolist()):
        assert np.allclose(table[:, cls == k].sum(1), 1, atol=1e-5)
    assert np.allclose(maxent.softmax(np.random.default_rng(0).normal(size=(3, 32))).sum(1), 1)


def test_words_of_a_class_depend_on_the_context(spark):
    """All answers follow the same word and so are of one class; only the word before that tells which of them comes."""
    rows = [(i, f"key{i % 40} then ans{i % 40}") for i in range(6000)] + [(10**6 + i, f"key{i % 40} then ans{(i + 7) % 40}") for i in range(800)]
    rows = [r for r in rows if (r[0] >= 10**6) == (zlib.crc32(str(r[0]).encode()) % 7 == 2) or r[0] < 10**6]
    got = [r for r in maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect() if r["held_out"]]
    right, wrong = (np.mean([r["score"] for r in got if (r["doc_id"] >= 10**6) == w]) for w in (False, True))
    assert right > wrong + 0.3


@pytest.mark.parametrize("n", [0, 1, 40, 1500])
def test_steps_of_the_tree_are_a_distribution(n):
    """Over all frequent words and all leaves of the others, for any weights; the start is the count table."""
    rng = np.random.default_rng(n)
    vocab, count = np.sort(rng.integers(1, 1 << 63, n).astype(np.uint64)), rng.integers(1, 90, n)
    cls = rng.integers(1, 3, n)
    words = maxent.word_table(rng.integers(0, 5, (maxent.PREV, n + 1)).astype(float), count, cls)
    tree = maxent.Tree(cls, count, words, rng.integers(1, 9, 32))
    rest = rng.integers(1, 1 << 63, 4000).astype(np.uint64)
    _, one = np.unique(maxent.leaves(rest, 1), return_index=True)
    assert len(one) == 32
    tokens, at = np.append(vocab, rest[one]), np.append(np.arange(n), np.full(32, n))
    for scale in (0, 1):
        w = (scale * rng.normal(size=(1 << 14, maxent.CLASSES))).astype(np.float32)
        token, node, y, row = tree.steps(at, tokens, np.full(len(at), 5))
        r = maxent.rows_at(np.repeat(np.arange(5, dtype=np.uint64)[None], len(token), 0), node, 14)
        k = len(at)
        z = np.concatenate([maxent.logits(w, r[:k], tree.start[row[:k]]), maxent.logits(w, r[k:][:, maxent.DEEP], tree.start[row[k:]])])
        root = 1 / maxent.softmax(z[:1].copy())[0]
        lp = np.log(maxent.softmax(z)[np.arange(len(y)), y])
        within = np.exp(np.bincount(token, lp, len(at))) * root[tree.of[at]]
        for c in set(tree.of[at].tolist()):
            assert within[tree.of[at] == c].sum() == pytest.approx(1, abs=1e-3)
        if not scale:
            assert np.allclose(np.log10(within[:n]), words[5], atol=1e-3)


# --- classifiers



def test_dedup_sends_each_text_once_through_one_worker(spark):
    """The input's row beside the text holds no second text, and no second worker of a task decodes."""
    long = "é" + "".join(random.Random(3).choices("abcdefghij ", k=150))
    rows = [(2, long + "é tail", 157, "x"), (1, long, 151, None), (None, None, None, "y"), (4, long, 151, "z")]
    out = suffix.dedup_texts(spark.createDataFrame(rows, "doc_id long, text string, n_chars int, row string"))
    assert out.columns == ["doc_id", "text", "n_chars", "row"] and out.schema["n_chars"].dataType.simpleString() == "int"
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, long, 151, None), (2, "é tail", 6, "x"), (None, None, None, "y")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan


def test_updates_equal_plain_adagrad_and_only_training_texts_are_read(monkeypatch):
    rng = np.random.default_rng(5)
    for k, kinds in ((3000, 4), (3000, 700), (40, 4000), (1, 9), (0, 9)):
        rows = np.stack([np.zeros(k, np.int64), *(1 + (kinds * rng.random(k) ** 3).astype(np.int64) for _ in range(3))], 1)
        y, start = rng.integers(0, maxent.CLASSES, k), rng.normal(size=(k, maxent.CLASSES)).astype(np.float32)
        w, speed = (rng.normal(size=(1 << 14, maxent.CLASSES))).astype(np.float32), np.ones(1 << 14, np.float32)
        z = start.astype(float) + w[rows].astype(float).sum(1)
        g, plain, pace = maxent.softmax(z) - np.eye(maxent.CLASSES)[y], w.astype(float), speed.astype(float)
        for j in range(rows.shape[1]):
            total, n = np.zeros(plain.shape), np.bincount(rows[:, j], minlength=len(w))
            np.add.at(total, rows[:, j], g)
            total /= np.sqrt(np.maximum(n, 1))[:, None]
            pace += (total**2).mean(1)
            plain -= maxent.RATE * total / np.sqrt(pace)[:, None]
        maxent.update(w, speed, rows, start, y, maxent.Room())
        assert np.allclose(w, plain, atol=1e-4) and np.allclose(speed, pace, rtol=1e-4)
    z = np.array([[0.0] * 32, [400.0] + [300.0] * 31, [-500.0] * 31 + [-600.0]], np.float32)
    e, whole = maxent.exps(z, maxent.Room())
    assert np.allclose(z[:, 0] - np.log(whole), [-np.log(32), 0, -np.log(31)], atol=1e-5) and np.allclose(e / whole[:, None], maxent.softmax(z))
    vocab = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    vocab[:9] = np.arange(9)  # share their upper bits
    tokens = np.concatenate([vocab, rng.integers(0, 1 << 63, 9000).astype(np.uint64), np.arange(20, dtype=np.uint64)])
    place = {v: i for i, v in enumerate(vocab.tolist())}
    assert maxent.lookup(tokens, vocab).tolist() == [place.get(t, 500) for t in tokens.tolist()] and maxent.lookup(tokens, vocab[:0]).tolist() == [0] * len(tokens)
    read, hashed = [], maxent.word_hashes
    monkeypatch.setattr(maxent, "word_hashes", lambda d, off: read.append(len(off) - 1) or hashed(d, off))
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(90), pa.int64()), "text": pa.array(["a b"] * 90)})
    rounds = [[r.tolist() for r, _, _ in maxent.token_pieces(maxent._train_rows(b, k), 1)] for k in range(maxent.ROUNDS)]
    assert sum(len(x) for r in rounds for x in r) == sum(read) == sum(not maxent.held_out(i) for i in range(90)) < 90


def prose(spark, bad):
    rng = np.random.default_rng(0)
    out = []
    for i in range(300):
        w = [f"word{k}" for k in rng.integers(0, 300, 60)]
        out.append((i, " ".join(bad(w, rng) if i % 4 == 0 else w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in out], "doc_id long, text string")
    return docs, out


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_held_out_rows(spark, module):
    def junk(w, rng):
        return [x + "***" for x in w]

    def insult(w, rng):
        return [x if rng.random() < 0.9 else "scum" for x in w] + ["scum"]

    docs, out = prose(spark, junk if module is quality else insult)
    labels = spark.createDataFrame([(i, 1 - b, b) for i, _, b in out], "doc_id long, quality int, toxic int")
    bad = {i: b for i, _, b in out}
    rows = [r for r in module.scores(docs, labels).collect() if r["held_out"]]
    good = 0 if module is toxicity else 1
    right = [r["predicted"] == (bad[r["doc_id"]] if module is toxicity else 1 - bad[r["doc_id"]]) for r in rows]
    assert len(rows) > 30 and np.mean(right) > 0.9, good


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_rows(docs, none, labels, rows, module):
    got = module.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert module.scores(none, labels).collect() == []
    assert len(module.scores(docs, labels.limit(0)).collect()) == len(rows)


def test_gradients():
    """The network's gradient is that of its loss."""
    import pyarrow as pa

    from utterloom.llm.text import utf8

    w = toxicity.Words(*utf8(pa.array(["some plain words here and more words to read", "short one"])))
    doc, first = toxicity.windows(w.border)
    win = toxicity.window_tokens(w.token, w.border, doc, first)
    net, y = toxicity.Network(), np.array([1.0, 0.0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z, cache = net.forward(net.inputs(net.embed(w)), win, True)
        return float((np.logaddexp(0, z) - y * z).sum()), z, cache

    _, z, cache = loss()
    g, _ = net.backward(net.embed(w), win, cache, toxicity.sigmoid(z) - y)
    for k in ("u", "wx", "att", "out"):
        at = np.unravel_index(3, net.p[k].shape)
        keep, eps = net.p[k][at], 1e-3
        net.p[k][at] = keep + eps
        up = loss()[0]
        net.p[k][at] = keep - eps
        down = loss()[0]
        net.p[k][at] = keep
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-3)


# --- pages


PAGES = [(1, "http://a.example.com/en/1", "x" * 2000), (2, "http://b.net/es/2", "x" * 2000), (3, None, None), (4, "no scheme", ""), (5, "HTTP://WWW.Example.COM/en/5?q#f", "y" * 10), (6, "http://c.net", "y" * 10), (None, "http://x.org/a/7", "x" * 2000), (8, "http://sub.net/fr/", "é" * 600), (8, "http://sub.net/fr/", "é" * 600)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, host int")


def test_warc_round_trip(pages):
    got = warc.round_trip(pages).collect()
    largest = {}
    for i, _, h in PAGES:
        if h and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        to = largest.get(h)
        again = to is not None and to != i
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_salvage():
    members = [warc.member(warc.record_bytes(k, f"u{k}", "response", p := bytes([65 + k]) * 500, warc.sha1_hex(p), 500, None)) for k in range(4)]
    plain = warc.record_bytes(9, "u9", "response", b"zz", warc.sha1_hex(b"zz"), 2, None)
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 255
    data = members[0] + bytes(broken) + b"junk" + members[2] + plain + members[3][:-9]
    found = list(warc.salvage(io.BytesIO(data)))
    assert [r["page_id"] for _, r, _, _ in found if r] == [0, 2, 9]
    gaps = [(o, n) for o, r, n, why in found if r is None and why]
    assert gaps == [(len(members[0]), len(broken) + 4), (len(data) - len(members[3]) + 9, len(members[3]) - 9)]
    assert sum(n for _, _, n, _ in found) == len(data)


def test_urls(spark, pages):
    outcomes = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (6, 0), (6, None)], "page_id long, good int")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, outcomes).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("b.net", "/es/2", "net/es/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None)
    assert got[5] == ("www.example.com", "/en/5", "www.example.com/en/", "allow")
    assert got[6][:3] == ("c.net", "", None)
    assert len(urls.judge(pages, outcomes.limit(0)).collect()) == len(PAGES)
    many = spark.createDataFrame([(k, f"http://bad.org/{k}") for k in range(50)] + [(100 + k, f"http://good.org/{k}") for k in range(50)], "page_id long, url string")
    seen = spark.createDataFrame([(k, 0) for k in range(40)] + [(100 + k, 1) for k in range(40)], "page_id long, good int")
    verdict = {r["page_id"]: r["verdict"] for r in urls.judge(many, seen).collect()}
    assert verdict[49] == "block" and verdict[149] == "allow"


def test_piecewise_ids_are_the_tokenizers():
    enc, r = packing.Encoder(tokenizer_path()), random.Random(1)
    assert enc.fine
    alphabet = list("abXYZ019 '' ''s're'LL.,;!-_ \t\n\r\x0b\x0c\x1c\x7f\x85\xa0éÉñßàÿ×÷ªº²¼µıſĳǅΣς한국어漢字かな") + ["'s", "'t ", "\u0130", "\u0301", "\u0344", "\u0387", "\u2028", "\u3000", "\ufb01", "\u2460"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(8000)] + [None, "", "x" * 5000, "é" * 300 + " ×÷ a×b"]
    import pyarrow as pa

    for memory in (packing.MEMORY, 0):
        for k in range(0, len(texts), 3000):
            if not memory:
                enc.clear()
            data, off = packing.utf8(pa.array(texts[k : k + 3000]))
            ids, n = enc.encode(data, off, 1)
            upto = np.append(0, np.cumsum(n))
            for t, a, b in zip(texts[k : k + 3000], upto, upto[1:], strict=False):
                assert ids[a:b].tolist() == [*enc.tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_packed_numbers():
    x = np.random.default_rng(3).integers(0, 1 << 48, 1000, dtype=np.uint64)
    assert (nearjoin.unpacked48(nearjoin.packed48(x)) == x).all()
    for big in (5, 1 << 16):
        n = np.array([1, 2, big], np.int32)
        assert len(nearjoin.short_sizes(n)) == (6 if big == 5 else 12)


def test_a_hot_group_of_near_copies_is_compared_in_blocks(spark, monkeypatch):
    r, rows = random.Random(9), []
    base = [f"w{k}" for k in range(120)]
    for i in range(nearjoin.HOT + 40):  # two families that share a hot passage, members linked in chains
        family = base[:60] + [f"f{i % 2}x{k}" for k in range(240)]
        for _ in range(2):
            family[r.randrange(70, 290)] = f"e{r.randrange(10**9)}"
        rows.append((i, " ".join(family)))
    monkeypatch.setattr(nearjoin, "BLOCK_NODES", 16)
    got = nearjoin.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert by_id(got) == by_id(brute_classes(rows))


def test_the_join_without_a_filter(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOOM_MOST", 0)
    assert by_id(nearjoin.near_classes(docs).collect()) == by_id(brute_classes(rows))


def test_components_of_chains(spark):
    from utterloom.llm.graph import components

    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (101, 100), (7, 7)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {103: 100, 101: 100}


def test_a_word_in_a_row_is_read_each_time():
    import pyarrow as pa

    w = toxicity.Words(*utf8(pa.array(["no " * 70 + "yes", "no"])))
    assert np.diff(w.border).tolist() == [71, 1] and (w.token[:70] == w.token[0]).all()
    doc, first = toxicity.windows(w.border)
    assert (doc == 0).sum() == 4 and first[3] == 71 - toxicity.WINDOW


def test_scores_are_those_of_the_highest_window(spark):
    """A plain recomputation, a window at a time, of what the batches give."""
    import pyarrow as pa

    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "idiot", "x9"]) for _ in range(n)) for n in (3, 40, 90, 33, 5, 64)] * 12
    toxic = np.array(["idiot" in t for t in texts])
    toxic[:2] = [False, True]
    net, cut = toxicity.train(texts, toxic)
    got = np.concatenate(list(toxicity.score_pieces((net, cut), pa.RecordBatch.from_arrays([pa.array(texts[:6] + ["", None])], ["t"]), 0)))
    for t, s in zip(texts[:6], got, strict=False):
        words_, most = t.split(), -np.inf
        starts = sorted({*range(0, max(len(words_) - toxicity.WINDOW, 0), toxicity.STRIDE), max(len(words_) - toxicity.WINDOW, 0)})
        for a in starts:
            w = toxicity.Words(*utf8(pa.array([" ".join(words_[a : a + toxicity.WINDOW])])))
            win = toxicity.window_tokens(w.token, w.border, np.array([0]), np.array([0]))
            most = max(most, float(net.forward(net.inputs(net.embed(w)), win)[0][0]))
        assert s == pytest.approx(1 / (1 + math.exp(-(most - cut + math.log(0.7 / 0.3)))), abs=1e-4)
    assert got[6] == got[7]


def test_repeated_rows_do_not_widen_the_training_sample(spark, monkeypatch):
    rows = [(i, f"w{i} " + ("idiot " if i % 2 else "fine ") * 20) for i in range(40)] * 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(len(texts)))
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 15)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 15)
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert 0 < seen[0] <= 30 and 0 < seen[1] <= 10


def test_the_risk_is_the_non_negative_one():
    """One step's gradient against a numerical one of the stated risk."""
    rng = np.random.default_rng(2)
    pos, unl = rng.normal(1, 1, (20, 6)), rng.normal(0, 1, (30, 6))
    net, prior = quality.Network(np.concatenate([pos, unl])), 0.4
    p, u = net.scaled(pos), net.scaled(unl)

    def risk():
        a, b, c, d = net.p
        zp, zu = (np.tanh(x @ a + b) @ c + d[0] for x in (p, u))
        return prior * np.logaddexp(0, -zp).mean() + np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()

    a, b, c, d = net.p
    zp, zu = (np.tanh(x @ a + b) @ c + d[0] for x in (p, u))
    dp = (-prior * quality.sigmoid(-zp) - prior * quality.sigmoid(zp)) / len(p)
    g = [x + y for x, y in zip(net.grads(p, dp), net.grads(u, quality.sigmoid(zu) / len(u)), strict=True)]
    for k, at in ((0, (2, 3)), (1, (4,)), (2, (1,)), (3, (0,))):
        net.p[k][at] += 1e-5
        up = risk()
        net.p[k][at] -= 2e-5
        assert (up - risk()) / 2e-5 == pytest.approx(g[k][at], rel=1e-3, abs=1e-7)
        net.p[k][at] += 1e-5


def test_stages_keep_columns_of_any_name(spark, rows, labels):
    """Clashing names come back with their own values; nulls, empty, long and repeated rows go through every filtering stage."""
    extra = ["rid", "n_bytes", "kept", "gone", "cut", "row", "n_removed", "n_spans", "score", "score_", "n_chars"]
    df = spark.createDataFrame([(i, t, *(f"{c}{k}" for c in extra[:-1]), len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra[:-1]) + ", n_chars long")
    at = {c: k for k, c in enumerate(df.columns)}
    before = {tuple(r[at[c]] for c in ["doc_id", *extra[:-1]]): r for r in df.collect()}
    items = spark.createDataFrame([(1, " ".join(rows[0][1].split()[:20]))], "item_id long, text string")
    for out in (quality.keep_good(df, labels), suffix.dedup_texts(df), decontam.without_leaks(df, items)):
        assert out.schema == df.schema
        for r in out.collect():
            old = before[tuple(r[at[c]] for c in ["doc_id", *extra[:-1]])]
            assert r["text"] == old["text"] or len(r["text"]) == r["n_chars"] < len(old["text"])
    clean = {r["rid"] for r in decontam.without_leaks(df, items).collect()}
    assert {f"rid{k}" for k in range(len(rows))} - clean == {"rid0", "rid1", "rid2", "rid3", "rid17"}  # the item's text, edited, in capitals, without an id


def test_repeated_ids_have_one_order(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"b {passage}"), (1, f"a {passage}"), (2, f"c {passage}")]
    got = {tuple(r) for n in (1, 3) for r in suffix.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()}
    assert len(got) == 3 and sum(r[2] == 0 for r in got) == 1


def test_leaks_equal_alignment_of_all_pairs(spark):
    r = random.Random(8)
    items = [(k, " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(3, 40)))) for k in range(12)]
    docs = []
    for k in range(40):
        t = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 80))]
        x = items[r.randrange(12)][1].split()
        if k % 2:
            x = [w if r.random() > 0.15 else "e" for w in x]
            t[3:3] = x
        docs.append((k, " ".join(t)))
    got = {(p["doc_id"], p["item_id"]): p["score"] for p in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for j, x in items:
            a, b = np.array([hash(w) for w in x.split()]), np.array([hash(w) for w in t.split()])
            share = decontam.align(a, b)[0] / (2 * len(a))
            grams = {tuple(x.split()[q : q + 3]) for q in range(len(a) - 2)} & {tuple(t.split()[q : q + 3]) for q in range(len(b) - 2)}
            if share >= decontam.THRESHOLD and grams:
                want[i, j] = share
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_scores_of_the_language_model_recomputed(spark, monkeypatch):
    """Every token's class, the steps to its word and the share of its leaf, one after the other, from the trained weights."""
    r, kept, plain = random.Random(6), {}, maxent.train

    def train(docs, vocab, bucket, tree, root, bits):
        w = plain(docs, vocab, bucket, tree, root, bits)
        kept.update(w=w, vocab=vocab, bucket=bucket, tree=tree, bits=bits)
        return w

    monkeypatch.setattr(maxent, "train", train)
    monkeypatch.setattr(maxent.frequent, "__defaults__", (30,))
    rows = [(i, " ".join(f"w{min(int(r.expovariate(0.05)), 80)}" for _ in range(r.randrange(1, 30)))) for i in range(60)]
    got = {x["doc_id"]: x for x in maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    w, vocab, bucket, tree, bits = (kept[k] for k in ("w", "vocab", "bucket", "tree", "bits"))
    assert len(vocab) == 30 and np.abs(w).sum() > 0
    counts = Counter(t for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in [*text.split(), None])
    for i, text in rows[:20]:
        words_ = text.split()
        tokens = np.append(maxent.word_hashes(*utf8(_arrow([text])))[0], maxent.END)
        border, at = np.array([0, len(tokens)]), maxent.lookup(tokens, vocab)
        features, before = maxent.feature_hashes(tokens, border), maxent.previous(bucket[at], border, 1, maxent.PREV - 1)
        total = 0.0
        for k in range(len(tokens)):
            token, node, y, row = tree.steps(at[k : k + 1], tokens[k : k + 1], before[k : k + 1])
            for a in range(len(node)):
                used = range(maxent.FEATURES) if node[a] == 0 else maxent.DEEP
                z = tree.start[row[a]].astype(float)
                for j in used:
                    z = z + w[maxent.rows_at(features[k : k + 1], node[a : a + 1], bits)[0, j]]
                total += z[y[a]] - np.log(np.exp(z - z.max()).sum()) - z.max()
            if at[k] == len(vocab):
                word = words_[k] if k < len(words_) else None
                total += np.log(counts[word] + 1) - np.log(tree.mass[maxent.leaves(tokens[k : k + 1], tree.digits)[0]])
        assert got[i]["score"] == pytest.approx(total / np.log(10), rel=1e-3)


def _arrow(texts):
    import pyarrow as pa

    return pa.array(texts)


def test_the_weight_table_grows_with_the_tokens():
    """About a row for 16 tokens up to 2^18 rows, then a row for 256 up to 2^19; rows beyond 2^18 are updated like any other."""
    assert [maxent.row_bits(n) for n in (0, 1 << 20, 1 << 22, 23_209_938, 116_000_000, 600_000_000, 1 << 40)] == [14, 17, 18, 18, 19, 19, 19]
    rng = np.random.default_rng(6)
    small, high = rng.integers(0, 1 << 14, (500, 4)), 3 << 17
    y, start = rng.integers(0, maxent.CLASSES, 500), rng.normal(size=(500, maxent.CLASSES)).astype(np.float32)
    part = rng.normal(size=(1 << 14, maxent.CLASSES)).astype(np.float32)
    w, speed = np.zeros((1 << maxent.MOST_ROW_BITS, maxent.CLASSES), np.float32), np.ones(1 << maxent.MOST_ROW_BITS, np.float32)
    w[high : high + len(part)] = part
    maxent.update(w, speed, small + high, start.copy(), y, maxent.Room())
    maxent.update(part, pace := np.ones(len(part), np.float32), small, start.copy(), y, maxent.Room())
    assert (w[high : high + len(part)] == part).all() and (speed[high : high + len(part)] == pace).all()
    assert not w[:high].any() and not w[high + len(part) :].any()
