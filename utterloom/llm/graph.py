"""Connected components and block-wise sums, both as joins and aggregates of bounded groups."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least node that u reaches; least nodes themselves are left out.

    Alternating large-star and small-star rounds, each stored. A node's neighbours are only ever aggregated to their least
    one (partially before the shuffle); the join back meets one row for each node, so a hot node is split on its large side.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    size = e.count()
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        way = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = way.groupBy("u").agg(F.min("v").alias("m"))
        small = way.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        new = stored(small.filter("u <> v").distinct(), "edges")
        before, size = size, new.count()
        if size == before and not new.join(e, ["u", "v"], "left_anti").limit(1).count():  # the same edges: both sides are distinct
            discard(e)
            return new
        discard(e)
        e = new


def block_sums(parts: DataFrame, dtype: str, fan_in: int = 128, add_up=np.add, packed: bool = False, read: Callable[[bytes], np.ndarray] | None = None, tasks: int = 1 << 40) -> DataFrame:
    """block, data: the sum (or another ufunc) of equal-length arrays by block. ``parts``: part int, block int, data binary (of ``dtype``; ``packed``:
    compressed by zlib; or what ``read`` makes an array of ``dtype`` from).

    Three levels, the first two of at most ``fan_in`` arrays a task, so that the last has a few even of millions of parts; the result is as large as one task's set of
    blocks, whatever the number of tasks.
    """
    plain = _plain(dtype, packed)

    def adder(get: Callable[[bytes], np.ndarray]):
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = None
            for raw in pdf["data"]:
                total = get(raw).copy() if total is None else add_up(total, get(raw))
            return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // fan_in], "block": [pdf["block"].iloc[0]], "data": [zlib.compress(total.tobytes(), 1) if packed else total.tobytes()]})

        return add

    schema = "part int, block int, data binary"
    level, get, levels = parts, read or plain, min(3, max(1, math.ceil(math.log(max(tasks, 2), fan_in))))
    for k in range(levels):
        keys = ["block"] if k == levels - 1 else ["block", "group"]
        level, get = level.withColumn("group", F.floor(F.col("part") / fan_in)).groupBy(*keys).applyInPandas(adder(get), schema), plain
    return level.select("block", "data")


def sum_blocks(parts: DataFrame, dtype: str, packed: bool = False, **more) -> dict[int, np.ndarray]:
    """``block_sums`` as arrays by block, all at once on the driver."""
    plain = _plain(dtype, packed)
    return {r["block"]: plain(r["data"]) for r in block_sums(parts, dtype, packed=packed, **more).collect()}


def _plain(dtype: str, packed: bool) -> Callable[[bytes], np.ndarray]:
    return (lambda raw: np.frombuffer(zlib.decompress(raw), dtype)) if packed else (lambda raw: np.frombuffer(raw, dtype))
