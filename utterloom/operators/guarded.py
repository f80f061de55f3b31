"""Joins that do not lose rows silently: a missing, extra or repeated key fails the read.

The check stands in the join's own filter, so it costs no second job and cannot be pruned. ``repeated`` is one partial aggregate on
the looked-up side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(keys: Sequence[str]) -> Column:
    return F.concat_ws("/", *(F.col(k).cast("string") for k in keys))


def _fail_where(df: DataFrame, bad: Column, message: str, keys: Sequence[str]) -> DataFrame:
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(_text(keys), F.lit(""))))).otherwise(F.lit(True)))


def unique(df: DataFrame, keys: Sequence[str], message: str = "a key repeats") -> DataFrame:
    """``df`` by key, which fails if one repeats: one row for each key, met in a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest) if rest else F.lit(0)).alias("_r"))
    one = _fail_where(one, F.col("_n") > 1, message, keys)
    return one.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def lookup(rows: DataFrame, known: DataFrame, keys: Sequence[str], message: str = "not in the data set") -> DataFrame:
    """``rows`` with the columns of ``known``, which must have each row's key, once."""
    there = unique(known, keys).withColumn("_there", F.lit(True))
    return _fail_where(rows.join(there, list(keys), "left"), F.col("_there").isNull(), message, keys).drop("_there")


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], message: str = "the key sets differ") -> DataFrame:
    """Both sides' columns by key; both must have the same keys, each once."""
    left, right = unique(a, keys).withColumn("_a", F.lit(True)), unique(b, keys).withColumn("_b", F.lit(True))
    return _fail_where(left.join(right, list(keys), "full_outer"), F.col("_a").isNull() | F.col("_b").isNull(), message, keys).drop("_a", "_b")


def same_conditions(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    """For one-row manifests joined as structs ``a`` and ``b``: the names of the conditions that differ."""
    return F.filter(F.array(*(F.when(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), c) for c in columns)), lambda x: x.isNotNull())


def paired_runs(control: DataFrame, run: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """control, run and the altered items' description by item: all three must have the same items."""
    as_struct = lambda df, name: df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))
    both = one_to_one(as_struct(control, "control"), as_struct(run, "run"), [key], "control and run have different items")
    return one_to_one(both, as_struct(made, "made"), [key], "the altered items are not the run's")


def labelled(sample: DataFrame, by_key: DataFrame, by_item: DataFrame, stratum: str) -> DataFrame:
    """Labels of a sample: rows of ``stratum`` by item_id from ``by_item``, all others by key from ``by_key``; each must be there."""
    here = F.col("stratum") == stratum
    return lookup(sample.filter(here), by_item, ["item_id"], "no label").unionByName(lookup(sample.filter(~here), by_key, ["key"], "no label"))


def heard_items(items: DataFrame, index: DataFrame, heard: DataFrame, rewrite=None) -> DataFrame:
    """Items (item_id, turns) with each turn's text replaced by what was heard, the written ones kept as ``written``.

    ``index``: item_id, turn, key, silent; every turn must be there, every sounding one must have a row (key, heard). ``rewrite``: Column
    function over the heard text.
    """
    turns = items.select("item_id", F.posexplode("turns").alias("turn", "t")).withColumn("turn", F.col("turn").cast("long"))
    at = lookup(turns, index, ["item_id", "turn"], "turn not in the index")
    known = unique(heard, ["key"]).withColumnRenamed("heard", "_heard").withColumn("_there", F.lit(True))
    got = _fail_where(at.join(known, "key", "left"), ~F.col("silent") & F.col("_there").isNull(), "nothing heard for", ["key"])
    text = F.when(F.col("silent"), "").otherwise(F.col("_heard"))
    text = rewrite(text) if rewrite else text
    listed = got.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("t.speaker").alias("speaker"), text.alias("text"), F.col("t.text").alias("written")))).alias("x"))
    pick = lambda *names: F.transform("x", lambda t: F.struct(*(t[n].alias(n) for n in names)))
    return listed.select("item_id", pick("speaker", "text").alias("turns"), F.transform("x", lambda t: t["written"]).alias("written"))


def reply_equality(rows: DataFrame, reference: DataFrame, key: str, text: str) -> DataFrame:
    """n and how many replies are those of a reference run, letter by letter; a reply without one differs."""
    other = unique(reference.select(key, F.col(text).alias("_text")), [key])
    return rows.join(other, key, "left").agg(F.count("*").alias("n"), F.count_if(F.col(text) == F.col("_text")).alias("identical"))


def rater_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: facts and agreement of two raters (item_id, verdicts, ok). One-sided, failed and unequally long items do not count."""
    mine, other = a.filter("ok").select("item_id", F.col("verdicts").alias("x")), unique(b.filter("ok").select("item_id", F.col("verdicts").alias("y")), ["item_id"])
    both = mine.join(other, "item_id").filter(F.size("x") == F.size("y"))
    same = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda s: s))
    sums = both.agg(F.coalesce(F.sum(F.size("x")), F.lit(0)).cast("long").alias("facts"), F.coalesce(F.sum(same), F.lit(0)).cast("long").alias("same"))
    return sums.select("facts", F.try_divide(F.col("same").cast("double"), F.col("facts").cast("double")).alias("agreement"))
