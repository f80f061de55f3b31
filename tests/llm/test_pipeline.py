"""The pipeline's stages on a small fixture, each compared with a brute-force version on its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from test_operators import brute_classes, brute_removed
from utterloom.llm import decontam, packing, quality
from utterloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Prose and junk with labels; near and exact copies, passages that repeat, benchmark copies, rows without an id, empty and null texts."""
    r, folder = random.Random(11), tmp_path_factory.mktemp("sf")
    prose = lambda n: " ".join(f"word{r.randrange(900)}" for _ in range(n))
    rows = [(i, prose(r.randrange(60, 120))) for i in range(120)] + [(200 + i, "$$$ " + " ".join(f"{r.randrange(10**6)}%%" for _ in range(80))) for i in range(60)]
    passage, items = prose(40), [(k, prose(20)) for k in range(3)]
    for i in range(10):
        words = rows[i][1].split()
        words[r.randrange(len(words))] = "other"
        rows += [(300 + i, rows[i][1]), (400 + i, " ".join(words)), (500 + i, f"{prose(50)} {passage} {prose(20)}")]
    for k, x in items:
        rows += [(600 + k, f"{prose(40)} {x[1] if isinstance(x, tuple) else x} {prose(40)}")]
    rows += [(None, rows[3][1]), (None, prose(70)), (None, f"{prose(30)} {items[0][1]}"), (700, None), (701, ""), (702, rows[20][1]), (702, prose(50))]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i is not None and i < 260], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def brute_leak(text, items):
    words = np.array([hash(w) for w in (text or "").split()])
    return any(len(words) and decontam.align(np.array([hash(w) for w in x.split()]), words)[0] / (2 * len(x.split())) >= decontam.THRESHOLD for x in items)


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    at = {}
    for name, stage in pipeline.STAGES:
        at[name] = (docs, stage(spark, docs, sf_dir).cache())
        docs = at[name][1]
        if name != "packing":
            assert docs.schema.simpleString() == at["quality"][0].schema.simpleString()

    before, after = at["quality"]
    scored = quality.with_scores(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert pairs(after) == pairs(scored.filter(f"score >= {quality.CUT}"))
    kept = {i for i, _ in pairs(after)}
    assert sum(i in kept for i in range(120)) > 108 and sum(i in kept for i in range(200, 260)) < 6

    before, after = (pairs(x) for x in at["near duplicates"])
    classes = brute_classes([(k, t) for k, (_, t) in enumerate(before)])
    assert after == [row for row, (k, _, least) in zip(before, classes, strict=True) if k == least] and len(after) < len(before)

    before, after = (pairs(x) for x in at["suffix array"])
    removed = brute_removed([(k, t) for k, (_, t) in enumerate(before)])
    assert [i for i, _ in after] == [row[0] for row, (_, size, gone, *_) in zip(before, removed, strict=True) if gone < size or not size]
    left = [(t, size - gone) for (_, t), (_, size, gone, *_) in zip(before, removed, strict=True) if gone < size or not size]
    assert sorted(len((t or "").encode()) for _, t in after) == sorted(n for _, n in left) and any(x[2] for x in removed)

    before, after = (pairs(x) for x in at["decontamination"])
    assert after == [row for row in before if not brute_leak(row[1], items)] and len(after) < len(before)

    docs, cut = at["packing"]
    tok = packing.Encoder(tokenizer_path()).tok
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(docs))
    rows = cut.collect()
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == want and sum(r["length"] for r in rows) == sum(want)
    end = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == packing.LENGTH for s, n in end.items() if s < max(end))


def test_run_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["doc_tokens"])
    assert sorted({key(r) for r in docs.collect()}) == sorted({key(r) for r in pipeline.run(spark, sf_dir).collect()})


def test_an_empty_table_goes_through(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.collect() == []
