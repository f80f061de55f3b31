"""Scoring, metrics, resampling and agreement: every metric is sums of counts plus a closed form.

So the same definition serves plain, grouped and bootstrapped evaluation, and Spark sums partially before each shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Samples of a group, about, and groups of samples at most.
DRAWS, GROUPS = 40, 48


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL if den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


#: name -> (columns that are summed, closed form over the sums). The registry of user-defined metrics.
METRICS: dict[str, tuple[Sequence[str], Callable[..., Column]]] = {
    "entity_p": (("tp", "fp"), lambda tp, fp: ratio(tp, tp + fp)),
    "entity_r": (("tp", "fn"), lambda tp, fn: ratio(tp, tp + fn)),
    "entity_f1": (("tp", "fp", "fn"), f1),
    "exact": (("exact", "n"), ratio),
    "hallucination": (("unfound", "predicted"), ratio),
}


def evaluate(items: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Metrics by name over per-item count columns, in one aggregate; ``n`` counts items."""
    needed = sorted({c for m in names for c in METRICS[m][0]} - {"n"})
    sums = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in needed]
    total = items.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return total.select(*by, "n", *(METRICS[m][1](*(F.col(c) for c in METRICS[m][0])).alias(m) for m in names))


def multiset_match(gold: DataFrame, pred: DataFrame, item: Sequence[str], key: Sequence[str]) -> DataFrame:
    """tp, fp and fn of each item by counts of equal keys. Predictions with a NULL key match nothing and count as fp."""
    cols = [*item, *key]
    g = gold.groupBy(*cols).agg(F.count("*").alias("g"))
    p = pred.groupBy(*cols).agg(F.count("*").alias("p"))
    both = g.join(p, cols, "full_outer").fillna(0, ["g", "p"])
    add = lambda c, n: F.sum(c).cast("long").alias(n)
    return both.groupBy(*item).agg(add(F.least("g", "p"), "tp"), add(F.greatest(F.col("p") - F.col("g"), F.lit(0)), "fp"), add(F.greatest(F.col("g") - F.col("p"), F.lit(0)), "fn"))


def set_counts(gold: Column, pred: Column) -> tuple[Column, Column, Column]:
    """tp, fp, fn of two arrays as sets."""
    size = lambda c: F.size(c).cast("long")
    return size(F.array_intersect(gold, pred)), size(F.array_except(pred, gold)), size(F.array_except(gold, pred))


def macro_f1(rows: DataFrame, by: Sequence[str], gold: str, pred: str) -> DataFrame:
    """Mean F1 over the labels that gold has, by group. Predictions elsewhere count against their label if gold has it."""
    g = rows.groupBy(*by, F.col(gold).alias("label")).agg(F.count("*").alias("gold_n"), F.sum((F.col(gold) == F.col(pred)).cast("long")).alias("tp"))
    p = rows.groupBy(*by, F.col(pred).alias("label")).agg(F.count("*").alias("pred_n"))
    each = g.join(p, [*by, "label"], "left").fillna(0, ["pred_n"])
    each = each.withColumn("f1", f1(F.col("tp"), F.col("pred_n") - F.col("tp"), F.col("gold_n") - F.col("tp")))
    return each.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def discrete_percentiles(rows: DataFrame, value: str, qs: Sequence[tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Values at fixed ranks: the middle is v[n div 2], any other quantile v[int(q * (n - 1))].

    Counts of equal values are summed before anything is ordered, so a group costs as much as its distinct values.
    """
    from pyspark.sql import Window as W

    by = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(*by).orderBy(value)
    at = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy(*by)))
    rank = lambda q: F.expr("n div 2") if q == 0.5 else F.floor(F.lit(q) * (F.col("n") - 1))
    pick = [F.min(F.when(F.col("upto") > rank(q), F.col(value))).alias(name) for name, q in qs]
    return at.groupBy(*by).agg(F.max("n").alias("n"), *pick)


def resampled(items: DataFrame, cols: Sequence[str], order: str, n_boot: int, seed: str = "0") -> DataFrame:
    """(rep, n (how many, unless a column has that name), sums of ``cols``) of ``n_boot`` draws of as many items, with replacement. ``order`` is a unique column.

    The items are sorted and packed as one small array a column, which goes to each group of samples; draws are made there
    (``draws``) and never become rows. The items' arrays must fit into a task, at one byte a value if values are small.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from .draws import drawn_sums

    cols, k = list(cols), len(cols)
    groups = max(1, min(n_boot // DRAWS, GROUPS))

    def pack(batches):
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            kinds, data = "", []
            for c in b.columns:
                for x in (c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)):
                    kind = next(t for t in "bhiq" if len(x) == 0 or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max))
                    kinds += kind
                    data.append(x.astype(kind).tobytes())
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([kinds]), pa.array([data], pa.list_(pa.binary()))], names=["part", "seq", "kinds", "data"])

    def draw(batches):
        mine, rows = [], {}
        for b in batches:
            for g, part, seq, kinds, data in zip(*(b.column(n).to_pylist() for n in ("g", "part", "seq", "kinds", "data")), strict=True):
                if g not in mine:
                    mine.append(g)
                if g == mine[0]:  # all groups have the same items
                    rows[part, seq] = kinds, data
        if not mine:
            return
        packed = [x for _, x in sorted(rows.items())]
        arrays = [np.concatenate([np.frombuffer(d[j], t[j]) for t, d in packed]) for j in range(2 * k)]
        values, valid = arrays[::2], arrays[1::2]
        gaps = [j for j in range(k) if not valid[j].all()]
        out = []
        for rep in (r for g in mine for r in range(g, n_boot, groups)):
            sums = drawn_sums(seed, rep, values + [valid[j] for j in gaps])
            some = dict(zip(gaps, sums[k:], strict=True))
            out.append([rep, *([] if "n" in cols else [len(values[0])]), *(sums[j] if some.get(j, 1) else None for j in range(k))])
        names = ["rep", *([] if "n" in cols else ["n"]), *cols]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if j else pa.int32()) for j, x in enumerate(zip(*out, strict=True))], names=names)

    ordered = items.orderBy(order).select(*(F.col(c).cast("long").alias(c) for c in cols))
    packed = ordered.mapInArrow(pack, "part int, seq int, kinds string, data array<binary>")
    dealt = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "part", "seq", "kinds", "data").repartition(groups, "g")
    return dealt.mapInArrow(draw, "rep int" + "".join(f", `{c}` long" for c in ([] if "n" in cols else ["n"]) + cols))


def bootstrap(items: DataFrame, metric: str, order: str, n_boot: int, seed: str = "0", alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a metric over ``resampled`` items; undefined draws are dropped."""
    cols = [c for c in METRICS[metric][0] if c != "n"]
    reps = resampled(items, cols, order, n_boot, seed)
    return interval(reps.select(METRICS[metric][1](*(F.col(c) for c in METRICS[metric][0])).alias("v")), alpha)


def ratio_bootstrap(items: DataFrame, num: str, den: str, order: str, n_boot: int, seed: str = "0", alpha: float = 0.05) -> DataFrame:
    """Interval of the ratio of two summed columns."""
    return interval(resampled(items, [num, den], order, n_boot, seed).select(ratio(F.col(num), F.col(den)).alias("v")), alpha)


def flag_difference(a: DataFrame, b: DataFrame, flag: str, key: str, n_boot: int, seed: str = "0") -> DataFrame:
    """One row: diff of b's and a's share of a flag over the same items, its interval, and whether it is above 0."""
    METRICS.setdefault(f"share_{flag}", ((flag, "n"), ratio))
    x, y = (df.select(key, F.col(flag).cast("int").alias(flag)) for df in (a, b))
    share = lambda df, name: df.agg(F.avg(flag).alias(name))
    i = paired_bootstrap(x, y, f"share_{flag}", key, n_boot, seed)
    return i.crossJoin(share(x, "_a")).crossJoin(share(y, "_b")).select((F.col("_b") - F.col("_a")).alias("diff"), "low", "high", F.coalesce(F.col("low") > 0, F.lit(False)).alias("passed"))  # one row each


CELLS = ("aa", "ab", "ba", "bb")


def rating_cells(rows: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """An item's four counts over its facts: both say yes, only a, only b, none. ``a`` and ``b`` are boolean columns, a fact a row."""
    x, y = F.col(a), F.col(b)
    return rows.groupBy(item).agg(*(F.count_if(c).alias(n) for n, c in zip(CELLS, (x & y, x & ~y, ~x & y, ~x & ~y), strict=True)))


def kappa_bootstrap(cells: DataFrame, item: str, n_boot: int, seed: str = "0") -> DataFrame:
    """Interval of kappa where whole items are drawn, all their facts together; ``cells`` from ``rating_cells``."""
    return interval(resampled(cells, CELLS, item, n_boot, seed).select(kappa(*(F.col(c) for c in CELLS)).alias("v")))


def kappa_difference(a: DataFrame, b: DataFrame, item: str, n_boot: int, seed: str = "0") -> DataFrame:
    """One row: kappa(a) - kappa(b) and its interval over the same draws of both; ``a`` and ``b`` from ``rating_cells``."""
    from .guarded import one_to_one

    named = lambda df, s: df.select(item, *(F.col(c).alias(f"{s}_{c}") for c in CELLS))
    both = one_to_one(named(a, "x"), named(b, "y"), [item], "the raters have different items")
    cols = [f"{s}_{c}" for s in "xy" for c in CELLS]
    diff = lambda: kappa(*(F.col(f"x_{c}") for c in CELLS)) - kappa(*(F.col(f"y_{c}") for c in CELLS))
    point = both.agg(*(F.sum(c).alias(c) for c in cols)).select(diff().alias("diff"))
    return point.crossJoin(interval(resampled(both, cols, item, n_boot, seed).select(diff().alias("v"))).select("low", "high"))  # one row each


def interval(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """low and high of column v: sorted values at int(alpha/2 * (m-1)) and int((1-alpha/2) * (m-1)); m defined values."""
    from pyspark.sql import Window as W

    v = values.filter("v IS NOT NULL")
    ranked = v.select("v", (F.row_number().over(W.orderBy("v")) - 1).alias("r"), F.count("*").over(W.partitionBy()).alias("m"))
    at = lambda q: F.floor(F.lit(q) * (F.col("m") - 1))
    return ranked.agg(F.count("*").alias("draws"), F.max(F.when(F.col("r") == at(alpha / 2), F.col("v"))).alias("low"), F.max(F.when(F.col("r") == at(1 - alpha / 2), F.col("v"))).alias("high"))


def paired_bootstrap(a: DataFrame, b: DataFrame, metric: str, key: str, n_boot: int, seed: str = "0", alpha: float = 0.05) -> DataFrame:
    """Interval of metric(b) - metric(a) over the same draws of both; the runs must have the same keys."""
    from .guarded import one_to_one

    cols = [c for c in METRICS[metric][0] if c != "n"]
    side = lambda df, s: df.select(key, *(F.col(c).cast("long").alias(f"{s}_{c}") for c in cols))
    both = one_to_one(side(a, "a"), side(b, "b"), [key], "the runs have different items")
    reps = resampled(both, [f"{s}_{c}" for s in "ab" for c in cols], key, n_boot, seed)
    value = lambda s: METRICS[metric][1](*(F.col(c) if c == "n" else F.col(f"{s}_{c}") for c in METRICS[metric][0]))
    return interval(reps.select((value("b") - value("a")).alias("v")), alpha)


def kappa(both: Column, only_a: Column, only_b: Column, none: Column) -> Column:
    """Cohen's kappa of the four cells; NULL where chance agreement is 1."""
    n = (both + only_a + only_b + none).cast("double")
    po = F.try_divide((both + none).cast("double"), n)
    pe = F.try_divide((both + only_a).cast("double") * (both + only_b) + (none + only_b).cast("double") * (none + only_a), n * n)
    return F.when(pe < 1, (po - pe) / (1 - pe))


def kappa_table(rows: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """n, agreement, kappa, error recall (b of a) and false-error rate of boolean verdicts, by group."""
    x, y = F.col(a), F.col(b)
    cell = lambda c: F.sum(c.cast("long"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), cell(x & y).alias("aa"), cell(x & ~y).alias("ab"), cell(~x & y).alias("ba"), cell(~x & ~y).alias("bb"))
    c = {k: F.col(k) for k in ("aa", "ab", "ba", "bb")}
    return sums.select(*by, "n", ratio(c["aa"] + c["bb"], F.col("n")).alias("agreement"), kappa(c["aa"], c["ab"], c["ba"], c["bb"]).alias("kappa"), ratio(c["aa"], c["aa"] + c["ab"]).alias("error_recall"), ratio(c["ba"], c["ba"] + c["bb"]).alias("false_errors"))
