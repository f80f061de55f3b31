"""Request-log statistics: batch forms, and the same as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outcome_counts(log: DataFrame, outcome: str, outcomes: Sequence[str]) -> DataFrame:
    """Counts since the start, with 0 for outcomes that have not come yet."""
    spark = log.sparkSession
    every = spark.createDataFrame([(o,) for o in outcomes], "outcome string")
    seen = log.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))
    return every.join(seen, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def last_n(log: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The last n rows of each group (or of all)."""
    desc = [F.desc(c) for c in order]
    if not by:
        return log.orderBy(*desc).limit(n)
    return log.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*desc))).filter(F.col("_r") <= n).drop("_r")


def stream_outcomes(log: DataFrame, outcome: str) -> DataFrame:
    """Running counts, for ``complete`` mode."""
    return log.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))


def stream_last_n(log: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """After each batch, rank statistics of the last n values of each key that had rows; state is n values for a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"o": [], "v": []}) if not state.exists else pd.DataFrame({"o": list(state.get[0]), "v": list(state.get[1])})
        for b in batches:
            held = pd.concat([held, pd.DataFrame({"o": b[order].astype("int64"), "v": b[value].astype("float64")})])
            held = held.sort_values("o", kind="stable").tail(n)
        state.update((held["o"].astype("int64").tolist(), held["v"].astype("float64").tolist()))
        v = sorted(held["v"])
        yield pd.DataFrame({"key": [k[0]], "n": [len(v)], "p50": [v[len(v) // 2]], "p95": [v[int(0.95 * (len(v) - 1))]]})

    return log.groupBy(key).applyInPandasWithState(step, "key string, n long, p50 double, p95 double", "o array<long>, v array<double>", "update", "NoTimeout")


def windowed_counts(log: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: tumbling counts with a watermark."""
    return log.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def valid_requests(requests: DataFrame, problems, good: str, bad: str, checkpoint: str):
    """A query that parts a stream of requests into rows without problems and, with their problems, dead letters; both folders are
    appended to once for each batch. ``problems``: a Column of texts."""

    def write(batch: DataFrame, number: int) -> None:
        x = batch.withColumn("problems", problems).withColumn("batch", F.lit(number)).persist()
        try:
            for path, rows in ((good, x.filter(F.size("problems") == 0).drop("problems")), (bad, x.filter(F.size("problems") > 0))):
                rows.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that comes again replaces itself
        finally:
            x.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
