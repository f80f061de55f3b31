"""Ranking, quotas, picks, contamination and splits. Every order ends with a unique key; shuffles are by md5 of a seed and the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(seed: str, key: str) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)]


def take_first(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def round_robin(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows: the first of each group, then the second of each, and so on. Only candidates for the answer are sorted."""
    ranked = df.withColumn("turn_no", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("turn_no") <= n)
    return ranked.orderBy("turn_no", by, order).limit(n)


def quota(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """n rows over the groups evenly; what is left over goes to the last groups, in order of first appearance."""
    groups = df.groupBy(by).agg(F.min(order).alias("seen"))
    k = groups.agg(F.count("*").alias("k"))
    ranked = groups.withColumn("g", F.row_number().over(W.orderBy("seen", by))).crossJoin(F.broadcast(k))
    share = ranked.select(by, (F.floor(F.lit(n) / F.col("k")) + (F.col("g") > F.col("k") - F.lit(n) % F.col("k")).cast("int")).alias("quota"))
    numbered = df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order)))
    return numbered.join(share, by).filter("_r <= quota").drop("_r", "quota")


def few_shot(df: DataFrame, group: str, category: str, key: str, k: int, seed: str) -> DataFrame:
    """After a seeded shuffle: the first row of each category, then at most k of these for each group."""
    order = shuffled(seed, key)
    first = take_first(df, [group, category], order, 1)
    return take_first(first, [group], order, k)


def stratified_draw(df: DataFrame, strata: Sequence[tuple[str, Column, int]], key: str, seed: str, empty: Column) -> DataFrame:
    """Disjoint samples one after the other from one shuffled order: each stratum goes on behind the last row that the one
    before used; empty rows are passed over. ``strata``: (name, condition, n), few."""
    order, out, behind = shuffled(seed, key), None, None
    rows = df.withColumn("_h", order[0])
    for name, condition, n in strata:
        rest = rows.filter(condition & ~empty)
        if behind is not None:
            rest = rest.crossJoin(F.broadcast(behind)).filter(F.col("_last").isNull() | (F.struct("_h", key) > F.col("_last"))).drop("_last")
        part = rest.orderBy("_h", key).limit(n).withColumn("stratum", F.lit(name))
        behind_here = part.agg(F.max(F.struct("_h", key)).alias("_last"))
        behind = behind_here if behind is None else behind.union(behind_here).agg(F.max("_last").alias("_last"))
        out = part if out is None else out.union(part)
    return out.drop("_h")


def contaminated_ids(train: DataFrame, test: DataFrame, values: str, key: str) -> DataFrame:
    """Keys of test rows of whose value array some value stands in train's."""
    seen = train.select(F.explode(values).alias("v")).distinct()
    return test.select(key, F.explode(values).alias("v")).join(seen, "v", "left_semi").select(key).distinct()


def without_contaminated(train: DataFrame, test: DataFrame, values: str, key: str) -> DataFrame:
    return test.join(contaminated_ids(train, test, values, key), key, "left_anti")


def resumable(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of an append-only run."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def chunks(n: Column, i: Column, size: int) -> tuple[Column, Column]:
    """Chunk number of row i (from 0) and that chunk's size, the last one short."""
    c = F.floor(i / size)
    return c, F.least(F.lit(size), n - c * size)


def best(df: DataFrame, order: Sequence[Column], take: str) -> Column:
    """Argmax by a struct of keys, for ``agg``."""
    return F.max_by(F.col(take), F.struct(*order))
