"""Reports: timings and loads, rejections and finished splits, gates, rankings and decisions, altered copies, reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from . import scoring as S
from .choosing import take_first
from .dialogue import reason_class
from .guarded import lookup, one_to_one


def token_rate(tokens: Column, ns: Column) -> Column:
    """Tokens a second to one place; NULL without a time."""
    return F.round(F.try_divide(tokens.cast("double"), F.nullif(ns, F.lit(0)).cast("double") / 1e9), 1)


def discrete(values: Column, q: float) -> Column:
    """An order statistic of an array, as ``scoring.discrete_percentiles`` takes it."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = F.floor(F.size(v) / 2) if q == 0.5 else F.floor(F.lit(q) * (F.size(v) - 1))
    return F.when(F.size(v) > 0, F.get(v, at.cast("int")))


def with_first(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with first: whether it is its group's first request, which loads the model."""
    return rows.withColumn("first", F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1)


def bench_summary(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Timings of requests by group: the first apart, the others summed. ``rows``: wall_s, load_ns, prompt_ns, eval_ns, eval_count,
    prompt_count. Order statistics are of distinct values with counts, so a group is never one array."""
    x = with_first(rows, by, order)
    warm = ~F.col("first")
    only = lambda c: F.when(warm, F.col(c))
    per = F.when(warm & (F.col("eval_count") > 0) & (F.col("eval_ns") > 0), F.col("eval_count") / (F.col("eval_ns") / 1e9))
    base = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("first"), F.col("wall_s"))).alias("first_wall_s"), F.max(F.when(F.col("first"), F.round(F.coalesce("load_ns", F.lit(0)) / 1e9, 2))).alias("first_load_s"),
        token_rate(F.sum(only("eval_count")), F.sum(only("eval_ns"))).alias("gen_tok_s"), F.round(F.sum(only("prompt_count")) / F.count_if(warm), 1).alias("prompt_tokens_mean"),
        F.round(F.avg(only("wall_s")), 3).alias("latency_mean"), F.max(only("wall_s")).alias("latency_max"), F.count_if(F.col("eval_count").isNull() | F.col("eval_ns").isNull()).alias("missing_counters"),
    )
    rank = lambda c, qs: S.discrete_percentiles(x.filter(warm).withColumn("_v", c), "_v", qs, by).drop("n")
    out = base.join(rank(F.col("wall_s"), [("latency_p50", 0.5), ("latency_p95", 0.95)]), list(by), "left")
    return out.join(rank(per, [("tok_s_p50", 0.5)]).withColumn("tok_s_p50", F.round("tok_s_p50", 1)), list(by), "left")


def load_summary(rows: DataFrame, by: Sequence[str], wall: Column) -> DataFrame:
    """Requests by group: n, throughput over ``wall`` (an aggregate) with failed ones, latencies of those with status 200 only."""
    fine = F.when(F.col("status") == "200", F.col("latency_s"))
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.try_divide(F.count("*").cast("double"), wall), 3).alias("throughput"), F.round(F.avg(fine), 3).alias("mean"), F.max(fine).alias("max"))
    return base.join(S.discrete_percentiles(rows.filter("status = '200'"), "latency_s", [("p50", 0.5), ("p95", 0.95)], by).drop("n"), list(by), "left")


def histogram(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows by value, NULLs left out, most first, ties by value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("string").alias(value)).agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), value)


def overlap_report(items: DataFrame, train: DataFrame, key: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Items whose whole key stands in train, by label: n and their ids in order. ``items``: item_id, key and label columns."""
    both = items.join(train.select(*key).distinct(), list(key), "left_semi")
    return both.groupBy(*labels).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item_id")).alias("ids")).orderBy(F.desc("n"), *labels)


def split_by_overlap(run: DataFrame, items: DataFrame, train: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hits and items of a run on both sides of the overlap; an item that the data lack fails the read. ``run``: item_id, exact."""
    seen = items.join(train.select(*key).distinct().withColumn("_seen", F.lit(True)), list(key), "left").select("item_id", F.coalesce("_seen", F.lit(False)).alias("overlap"))
    return lookup(run, seen, ["item_id"]).groupBy("overlap").agg(F.count_if("exact").alias("hits"), F.count("*").alias("n"))


def rejection_summary(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: attempted, accepted, rejected, reject_rate (four places)."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both = n(accepted, "accepted").crossJoin(n(rejected, "rejected"))  # one row each
    total = F.col("accepted") + F.col("rejected")
    return both.select(total.alias("attempted"), "accepted", "rejected", F.round(S.ratio(F.col("rejected"), total), 4).alias("reject_rate"))


def rejected_by(rejected: DataFrame, specs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rejected specs by their labels; those whose spec is unknown are not counted here."""
    return rejected.join(specs.select("spec_id", *labels), "spec_id", "left").filter(F.col(labels[0]).isNotNull()).groupBy(*labels).agg(F.count("*").alias("n"))


def shortage(chosen: DataFrame, by: str, target: int) -> DataFrame:
    """Groups with fewer rows than wanted, and how many are missing; a group without any row is not known."""
    return chosen.groupBy(by).agg((F.lit(target) - F.count("*")).cast("long").alias("short")).filter("short > 0")


def finished_split(items: DataFrame, problems: Column, train_values: DataFrame | None, values: str, by: str, order: str, target: int) -> dict[str, DataFrame]:
    """A split after the last checks: ``recheck`` (item_id, problems), ``overlap`` (ids with a value of train's), ``chosen`` (the first
    ``target`` rows of each group that passed), ``short``. ``train_values``: one column v, or None for the training split itself."""
    x = items.withColumn("_p", problems)
    good = x.filter(F.size("_p") == 0).drop("_p")
    out = {"recheck": x.filter(F.size("_p") > 0).select("item_id", F.col("_p").alias("problems"))}
    if train_values is not None:
        hit = good.select("item_id", F.explode(values).alias("v")).join(train_values.select("v").distinct(), "v", "left_semi").select("item_id").distinct()
        out["overlap"], good = hit, good.join(hit, "item_id", "left_anti")
    out["chosen"] = take_first(good, [by], [order], target)
    out["short"] = shortage(out["chosen"], by, target)
    return out


def reasons(rejected: DataFrame) -> DataFrame:
    return rejected.select(F.explode("problems").alias("p")).groupBy(reason_class(F.col("p")).alias("reason")).agg(F.count("*").alias("n"))


def think_check(replies: DataFrame, run: str = "run") -> DataFrame:
    """By run: whether reasoning stayed off. ``replies``: thinking_chars, reply, done_reason, schema_ok, completion_tokens."""
    sums = replies.groupBy(run).agg(
        F.count("*").alias("n"), F.count_if(F.col("thinking_chars") > 0).alias("thinking_items"), F.count_if(F.col("reply").rlike("</?think>")).alias("think_tags"), F.count_if(F.col("done_reason") == "length").alias("length_stops"),
        F.count_if("schema_ok").alias("schema_ok"), F.max("completion_tokens").alias("completion_max"),
    )
    return sums.join(S.discrete_percentiles(replies, "completion_tokens", [("completion_p50", 0.5)], [run]).drop("n"), run, "left")


def call_class(status: Column, body: Column, context_full: Column, problems: Column) -> Column:
    """What the service makes of one model call."""
    exceeded = F.lower(body).contains("context") & F.lower(body).contains("exceed")
    return F.when(F.coalesce(status, F.lit(0)) != 200, F.when(F.coalesce(status.isNotNull() & exceeded, F.lit(False)), "context_exceeded").otherwise("model_unavailable")).when(F.coalesce(context_full, F.lit(False)), "context_full").when(F.size(problems) > 0, "retry").otherwise("ok")


def request_outcome(calls: DataFrame, key: str, attempt: str, kind: str) -> DataFrame:
    """A request's outcome and attempts from its calls (at most two count): a retry that is the last one rejects it. Token sums and
    flags are NULL where no call knows them."""
    x = calls.groupBy(key).agg(
        F.max_by(kind, attempt).alias("last"), F.max(attempt).cast("long").alias("attempts"), F.sum("tokens").alias("tokens"), F.max(F.col("context_full").cast("int")).cast("boolean").alias("context_full")
    )
    outcome = F.when(F.col("last") == "ok", F.when(F.col("attempts") == 1, "ok").otherwise("retried_ok")).when(F.col("last") == "retry", "rejected").otherwise(F.col("last"))
    return x.select(key, outcome.alias("outcome"), "attempts", "tokens", "context_full")


def options_gate(synthetic: DataFrame, dev: DataFrame, behaviour: Sequence[str]) -> DataFrame:
    """One row: do the options change a synthetic input's behaviour, and leave every dev reply as it is? Structs a and b are the two
    settings' results; dev has status and text. Without dev rows the default is kept."""
    differs = F.lit(False)
    for c in behaviour:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    fine = (F.col("a.status") == 200) & (F.col("b.status") == 200)
    s = synthetic.agg(F.count_if(differs).alias("changed_inputs"))
    d = dev.agg(F.count("*").alias("dev_n"), F.count_if(fine & (F.col("a.text") == F.col("b.text"))).alias("dev_identical"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("dev_errors"))
    both = s.crossJoin(d)  # one row each
    adopt = (F.col("changed_inputs") > 0) & (F.col("dev_n") > 0) & (F.col("dev_identical") == F.col("dev_n")) & (F.col("dev_errors") == 0)
    return both.withColumn("decision", F.when(adopt, "adopt").otherwise("keep_default"))


def is_idle(cpu: Column, gpu: Column, other_mib: Column) -> Column:
    """Whether a sample shows an idle machine: mean CPU below 15 %, mean GPU below 50 %, other programs' memory below 2560 MiB."""
    return (cpu < 15.0) & (gpu < 50.0) & (other_mib < 2560)


def identifier_gate(items: DataFrame, heard: DataFrame) -> DataFrame:
    """By arm and type: identifiers and those found in what was heard. ``items``: item_id, ids (array of struct(type, value));
    ``heard``: arm, item_id, turn, text. Items without a heard turn count with an empty text."""
    texts = heard.groupBy("arm", "item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("text"))
    arms = heard.select("arm").distinct()
    x = items.filter(F.size("ids") > 0).crossJoin(F.broadcast(arms)).join(texts, ["arm", "item_id"], "left")  # a few arms
    x = x.withColumn("index", V.text_index(F.coalesce("text", F.lit("")))).select("arm", "index", F.explode("ids").alias("e"))
    return x.groupBy("arm", F.col("e.type").alias("type")).agg(F.count_if(V.found_at(F.lit("id"), F.col("e.value"), F.col("index"), True)).alias("found"), F.count("*").alias("ids"))


def gate_verdict(found: DataFrame, base: str, reference: Sequence[str] = ()) -> DataFrame:
    """One row: go if some arm, neither the base nor a reference, finds more identifiers than the base."""
    total = found.groupBy("arm").agg(F.sum("found").alias("found"))
    candidate = (F.col("arm") != base) & ~F.col("arm").isin(*reference) if reference else F.col("arm") != base
    top = total.agg(F.max(F.when(candidate, F.col("found"))).alias("best"), F.max(F.when(F.col("arm") == base, F.col("found"))).alias("base"))
    return top.select("best", "base", F.when(F.col("best") > F.col("base"), "go").otherwise("stop").alias("verdict"))


def arm_ranking(arms: DataFrame) -> DataFrame:
    """Passed arms that are no reference, best first: arm, place. ``arms``: arm, low, diff, passed, catalogue, reference, ord (few)."""
    w = W.orderBy(F.desc("low"), F.desc("diff"), "catalogue", "ord")
    return arms.filter("passed AND NOT reference").select("arm", F.row_number().over(w).cast("long").alias("place"))


# What an adopted judge must reach.
KAPPA_MIN, MOST_FAILED = 0.6, 1


def adoption_reasons() -> Column:
    """Why a candidate is not adopted; undefined numbers fail."""
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    return F.filter(
        F.array(
            F.when(fails(F.col("kappa") >= KAPPA_MIN), "kappa"), F.when(fails(F.col("low_vs_base") > 0), "not above the baseline"), F.when(fails(F.col("diff_same_check") >= 0), "below the baseline with the same check"),
            F.when(F.col("n_failed") > MOST_FAILED, "failed judgements"), F.when(F.col("context_full") != 0, "context full"), F.when(F.col("thinking_items") != 0, "thinking"),
        ),
        lambda r: r.isNotNull(),
    )


def adopted(candidates: DataFrame) -> DataFrame:
    """One row: the passed candidate of largest kappa, then error recall (undefined is least), then latest registration."""
    passed = candidates.filter(F.size(adoption_reasons()) == 0)
    return passed.agg(F.max_by("name", F.struct("kappa", F.coalesce("error_recall", F.lit(-1.0)), "ord")).alias("adopted"))


def quarter(at: Column, n_turns: Column) -> Column:
    """Which quarter of a dialogue a place is in, 1 to 4."""
    return (F.lit(1) + F.floor(4 * at / n_turns)).cast("long")


def swap_follow(rows: DataFrame) -> DataFrame:
    """One row: of replaced numbers, how many the control had right and the run then followed. ``rows``: a replaced value a row: old and
    new key, control and run (arrays of the replies' keys)."""
    in_control, in_run = F.array_contains("control", F.col("old")), F.array_contains("run", F.col("new"))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    sums = rows.agg(F.count("*").alias("values"), n(in_control).alias("eligible"), n(in_control & in_run).alias("followed"), n(in_run).alias("followed_all"), n(F.array_contains("run", F.col("old"))).alias("old_in_run"))
    return sums.withColumn("follow_rate", S.ratio(F.col("followed"), F.col("eligible")))


def inject_follow(form: Column, target: Column, record: Column) -> Column:
    """Whether an injected value reached the structured fields of a reply; none of it without a record."""
    amount = F.exists(record["entities"], lambda e: V.norm_amount(e["value"]) == V.norm_amount(target))
    return F.coalesce(F.when(form == "resolution", record["resolution"] == target).when(form == "category", record["category"] == target).otherwise(amount), F.lit(False))


# Classes of a reviewed difference, worst last.
SEVERITY = ("정답 잡음", "애매", "모델 오류")


def worst(classes: Column) -> Column:
    """The worst class of an array; NULL if it is empty."""
    at = F.array_max(F.transform(classes, lambda c: F.array_position(F.array(*map(F.lit, SEVERITY)), c)))
    return F.when(at > 0, F.get(F.array(*map(F.lit, SEVERITY)), (at - 1).cast("int")))


def review_tally(targets: DataFrame, review: DataFrame) -> DataFrame:
    """Each target's label: that of the serving answer, else of the agreed ones. ``targets``: item_id, serving (array of fields, NULL if
    right), agreed (array of fields); ``review``: item_id, classes (map field -> class). Both must have the same items, and every
    field a known class."""
    x = one_to_one(targets, review, ["item_id"], "the review does not match the targets")
    of = lambda fields: F.transform(fields, lambda f: F.when(F.col("classes")[f].isin(*SEVERITY), F.col("classes")[f]).otherwise(F.raise_error(F.concat(F.lit("no class for "), F.col("item_id"), F.lit(" "), f))))
    serving = F.when(F.col("serving").isNotNull(), F.when(F.size("serving") == 0, SEVERITY[-1]).otherwise(worst(of(F.col("serving")))))
    x = x.select("item_id", serving.alias("serving"), F.when(F.size("agreed") > 0, worst(of(F.col("agreed")))).alias("agreed"))
    return x.withColumn("label", F.coalesce("serving", "agreed"))


def tally_shares(tally: DataFrame, exact: int, n: int) -> DataFrame:
    """One row: targets by label, the candidates' share of gold noise, and the score if the noisy errors were right."""
    noise = SEVERITY[0]
    sums = tally.agg(*(F.count_if(F.col("label") == s).alias(f"label_{i}") for i, s in enumerate(SEVERITY)), S.ratio(F.count_if(F.col("agreed") == noise), F.count("agreed")).alias("noise_share"), F.count_if(F.col("serving") == noise).alias("noisy_errors"))
    return sums.withColumn("ceiling", S.ratio(F.lit(exact) + F.col("noisy_errors"), F.lit(n)))


def blind_keys(sample: DataFrame, key: str, seed: str) -> DataFrame:
    """The sample with blind, a running number in an order of its own (k001, k002, ...); for samples of hundreds."""
    order = W.orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}:keys"), F.col(key).cast("string"))), key)
    return sample.withColumn("blind", F.format_string("k%03d", F.row_number().over(order)))


def balanced_forms(items: DataFrame, by: str, key: str, forms: Sequence[str], seed: str) -> DataFrame:
    """Items with form: dealt in turn within each group after a seeded shuffle, so that counts differ by one at most."""
    order = W.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key)
    return items.withColumn("form", F.get(F.array(*map(F.lit, forms)), F.pmod(F.row_number().over(order) - 1, F.lit(len(forms)))))


def occurrence(rows: DataFrame, item: Sequence[str], order: str) -> DataFrame:
    """``rows`` with k: the how-manieth of its equals it is, from 1."""
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*item).orderBy(order)).cast("long"))


def first_seen(rows: DataFrame, by: Sequence[str], label: str, order: str) -> DataFrame:
    """Distinct labels of a group as an array, by first appearance. Aggregated to one row a label before they are listed."""
    one = rows.groupBy(*by, label).agg(F.min(order).alias("_o"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", label))), lambda x: x[label]).alias("labels"))


def in_groups(rows: DataFrame, groups: DataFrame, stratum: str) -> DataFrame:
    """Rows once for each named group that has their stratum. ``groups``: grp, and the stratum's column."""
    return rows.join(groups, stratum)


def context_text(company: Column, values: Column) -> Column:
    """A domain's context: company and catalogue values, each once, by commas."""
    return F.array_join(F.array_distinct(F.concat(F.array(company), values)), ", ")


def run_name(model: Column, shots: Column, prompt: Column, default_prompt: str) -> Column:
    """How a run is shown: its model, the number of examples if any, its prompt unless it is the default."""
    return F.concat(model, F.when(F.coalesce(shots, F.lit(0)) > 0, F.concat(F.lit(" "), shots.cast("string"), F.lit("-shot"))).otherwise(""), F.when(prompt != default_prompt, F.concat(F.lit(" "), prompt)).otherwise(""))


def review_rows(items: DataFrame) -> DataFrame:
    """Review sheets without model answers: numbered turns, and for each value the numbers of the turns that have it letter by letter.

    ``items``: item_id, turns, values (array of struct(type, value))."""
    number = lambda i: (i + 1).cast("int")
    turns = F.transform("turns", lambda t, i: F.concat(number(i).cast("string"), F.lit(" "), t["speaker"], F.lit(": "), t["text"]))
    where = lambda v: F.filter(F.transform("turns", lambda t, i: F.when(t["text"].contains(v), number(i))), lambda i: i.isNotNull())
    found = F.map_from_entries(F.transform(F.array_distinct("values"), lambda v: F.struct(F.concat(v["type"], F.lit(" "), v["value"]), where(v["value"]))))
    return items.select("item_id", turns.alias("lines"), found.alias("value_turns")).withColumnRenamed("lines", "turns")


def fingerprint_guard(manifests: DataFrame, sha: str) -> DataFrame:
    """``manifests``; fails where a run was not measured on the file of that fingerprint."""
    odd = ~F.col("data_sha").eqNullSafe(F.lit(sha))
    return manifests.filter(F.when(odd, F.raise_error(F.concat(F.lit("another data file: "), F.coalesce("data_sha", F.lit("none"))))).otherwise(F.lit(True)))


def filler(unit: Column, most: int) -> Column:
    """As many copies of a turn's line as fit into ``most`` characters, line breaks between them counted."""
    n = F.floor((F.lit(most) + 1) / (F.length(unit) + 1)).cast("int")
    return F.array_repeat(unit, F.greatest(n, F.lit(0)))


def limit_rows(rows: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first n rows in file order; all of them without a limit."""
    return rows if n is None else rows.orderBy(*order).limit(n)
