"""JSON Lines, run folders, reports and streams."""

import pytest
from pyspark.sql import functions as F

from utterloom.operators import choosing as C
from utterloom.sources import jsonl as J
from utterloom.streaming import stats as T


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "한글"), ("b", None)], "item_id string, text string")
    path = str(tmp_path / "x")
    assert J.write_jsonl(rows, path) == 2
    assert sorted(map(tuple, J.read_jsonl(spark, path, "item_id string, text string").collect()), key=str) == [("a", "한글"), ("b", None)]
    more = spark.createDataFrame([("b", "again"), ("c", "new")], "item_id string, text string")
    assert J.append_new(more, path, "item_id", "item_id string, text string") == 1
    assert J.read_jsonl(spark, path, "item_id string, text string").count() == 3


def test_a_bad_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        J.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_runs(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "items.jsonl").write_text('{"item_id": "x"}\n')
    runs = J.read_runs(spark, str(tmp_path), "item_id string")
    assert sorted(r["run_id"] for r in runs.collect()) == ["r1", "r2"]
    with pytest.raises(Exception, match="repeats"):
        J.check_unique(runs, ["item_id"]).collect()


def test_text_forms(spark):
    x = spark.createDataFrame([(0.1234, "1005, 36", "a\\b"), (-0.0001, "x", "c"), (None, None, None)], "v double, line string, p string")
    got = x.select(J.fixed(F.col("v"), 1, 100.0), J.metric_line(F.col("line")), J.forward_slashes(F.col("p"))).collect()
    assert [r[0] for r in got] == ["12.3", "0.0", "-"] and tuple(got[0][1]) == (1005, 36) and got[1][1] is None and got[0][2] == "a/b"
    with pytest.raises(ValueError, match="other"):
        J.load_declarations("[[other]]\na = 1", ("number",))
    assert J.markdown(spark.createDataFrame([(1, None)], "a int, b int")) == "| a | b |\n| --- | --- |\n| 1 | - |"


def test_streamed_statistics_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 3}", float(i * 7 % 11)) for i in range(60)], "o long, k string, v double")
    for i in range(3):
        rows.filter(F.floor(F.col("o") / 20) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = T.stream_outcomes(log, "k").writeStream.outputMode("complete").format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["outcome"], r["n"]) for r in spark.table("outcomes").collect()} == {("k0", 20), ("k1", 20), ("k2", 20)}
    assert {(r["outcome"], r["n"]) for r in T.outcome_counts(rows, "k", ["k0", "no"]).collect()} == {("k0", 20), ("no", 0)}
    assert sorted(r["o"] for r in T.last_n(rows, ["o"], 2, ["k"]).collect()) == [54, 55, 56, 57, 58, 59]


def test_resumable(spark):
    a, b = spark.range(5), spark.range(3)
    assert sorted(r["id"] for r in C.resumable(a, b, "id").collect()) == [3, 4]
