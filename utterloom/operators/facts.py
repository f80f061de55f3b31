"""Facts of a call: templates and their slots, values that a summary keeps, judged facts, raters and their agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import scoring as S
from .dialogue import overlay
from .guarded import lookup, unique

# Verdicts on a fact, and the kinds of values that are looked for by their number.
INCLUDED, MISSING, WRONG = "포함", "누락", "틀림"
NUMERIC = ("id", "amount", "date", "time")


def fill(template: Column, slots: Column) -> Column:
    """The template with each {slot} replaced by its value. ``slots``: array of struct(slot, type, value)."""
    return F.aggregate(slots, template, lambda t, s: F.replace(t, F.concat(F.lit("{"), s["slot"], F.lit("}")), s["value"]))


def placeholders(template: Column) -> Column:
    """Slot names of a template, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{(\w+)\}"), F.lit(1)))


def fact_slots(templates: Column, facts: Column, slots: Column) -> Column:
    """The slots of each fact. Fails where the facts are not the templates filled with the slots."""
    same = F.transform(templates, lambda t: fill(t, slots)) == facts
    return F.when(same, F.transform(templates, placeholders)).otherwise(F.raise_error(F.lit("the facts are not the templates filled with the slots")))


def value_mentions(names: Column, slots: Column, kinds: Column) -> Column:
    """Numeric values of the facts: array of struct(fact, slot, type, kind, value); ``names`` from ``fact_slots``."""

    def of(fact: Column, i: Column) -> Column:
        hits = F.flatten(F.transform(fact, lambda n: F.filter(slots, lambda s: (s["slot"] == n) & kinds[s["type"]].isin(*NUMERIC))))
        return F.transform(hits, lambda s: F.struct(i.alias("fact"), s["slot"].alias("slot"), s["type"].alias("type"), kinds[s["type"]].alias("kind"), s["value"].alias("value")))

    return F.flatten(F.transform(names, of))


def with_found(mentions: Column, index: Column) -> Column:
    """Mentions with found: whether the indexed text has the value, by the rules of written text."""
    return F.transform(mentions, lambda m: F.struct(m["fact"].alias("fact"), m["kind"].alias("kind"), V.found_at(m["kind"], m["value"], index).alias("found")))


def fact_ok(n_facts: Column, found: Column) -> Column:
    """For each fact: NULL without numeric values, else whether all were found."""

    def of(i: Column) -> Column:
        mine = F.filter(found, lambda m: m["fact"] == i)
        return F.when(F.size(mine) > 0, F.forall(mine, lambda m: m["found"]))

    return F.when(n_facts > 0, F.transform(F.sequence(F.lit(0), n_facts - 1), of)).otherwise(F.array().cast("array<boolean>"))


def distractor_written(distractor: Column, kinds: Column, index: Column) -> Column:
    """Whether the value first said wrongly (struct(type, value) or NULL) stands in the text."""
    kind = kinds[distractor["type"]]
    return F.coalesce(V.normalize(kind, distractor["value"]).isNotNull() & V.found_at(kind, distractor["value"], index), F.lit(False))


def value_counts(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each item's counts. ``items``: item_id, domain, summary (NULL: none), templates, facts, slots, distractor."""
    x = items.join(catalogue.select("domain", "kinds"), "domain").withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("index", V.text_index(F.col("summary")))
    names = fact_slots(F.col("templates"), F.col("facts"), F.col("slots"))
    x = x.withColumn("found", with_found(value_mentions(names, F.col("slots"), F.col("kinds")), F.col("index")))
    x = x.withColumn("value_ok", fact_ok(F.size("facts"), F.col("found"))).withColumn("distractor_written", distractor_written(F.col("distractor"), F.col("kinds"), F.col("index")))
    count = lambda xs, f: F.size(F.filter(xs, f)).cast("long")
    return x.select(
        "item_id", "found", "value_ok", (F.regexp_replace("summary", r"(?U)\s", "") == "").alias("empty"), count("found", lambda m: m["found"]).alias("n_found"), F.size("found").cast("long").alias("n_mentions"),
        count("value_ok", lambda v: v).alias("facts_ok"), count("value_ok", lambda v: v.isNotNull()).alias("facts_valued"), F.col("distractor").isNotNull().alias("distractor"),
        "distractor_written",
    )


def value_table(counts: DataFrame) -> DataFrame:
    """One row of a run's value checks, from ``value_counts``."""
    total, n = lambda c: F.coalesce(F.sum(c), F.lit(0)), F.count_if
    valued = F.col("n_mentions") > 0
    return counts.agg(
        F.count("*").alias("n_items"), n("empty").alias("n_empty"), total("n_mentions").alias("n_mentions"), S.ratio(total("n_found"), total("n_mentions")).alias("value_recall"),
        S.ratio(total("facts_ok"), total("facts_valued")).alias("value_fact_recall"), S.ratio(n(valued & (F.col("n_found") == F.col("n_mentions"))), n(valued)).alias("items_all_values"),
        n("distractor").alias("distractor_items"), n("distractor_written").alias("distractor_in_summary"),
    )


def found_by_kind(counts: DataFrame) -> DataFrame:
    return counts.select(F.inline("found")).groupBy("kind").agg(F.count_if("found").alias("found"), F.count("*").alias("n"))


def judged(summary: Column, n_facts: Column, parsed: Column) -> Column:
    """struct(verdicts, wrong, ok): an empty summary misses all facts without being judged; an unreadable reply is not ok and has no verdicts."""
    none = F.array().cast("array<string>")
    row = lambda v, w, ok: F.struct(v.alias("verdicts"), w.cast("int").alias("wrong"), F.lit(ok).alias("ok"))
    empty = F.regexp_replace(F.coalesce(summary, F.lit("")), r"(?U)\s", "") == ""
    return F.when(empty, row(F.array_repeat(F.lit(MISSING), n_facts), F.lit(0), True)).when(F.coalesce(parsed["ok"], F.lit(False)), row(parsed["verdicts"], parsed["wrong"], True)).otherwise(row(none, F.lit(0), False))


def reply_fields(reply: Column) -> list[Column]:
    """What is kept beside a judgement; a reply that was never asked for has no counts and no time."""
    return [
        reply["prompt_tokens"].alias("prompt_tokens"), reply["completion_tokens"].alias("completion_tokens"), reply["done_reason"].alias("done_reason"), F.coalesce(F.round(reply["latency_s"], 3), F.lit(0.0)).alias("latency_s"),
        F.coalesce(F.length(reply["thinking"]), F.lit(0)).alias("thinking_chars"),
    ]


def typed_scores(rows: DataFrame) -> DataFrame:
    """item_id, verdicts, wrong_statements and ok of verdict rows; the last two may be missing: 0 and true."""
    have = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d)
    return rows.select("item_id", "verdicts", have("wrong_statements", 0).cast("int").alias("wrong_statements"), have("ok", True).cast("boolean").alias("ok"))


def judge_numbers(counts: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: failed judgements, recall of facts as judged and with the value check laid over, share of wrong summaries. All items
    of ``counts`` must be judged; failed ones count nowhere else."""
    x = lookup(counts.select("item_id", "value_ok"), typed_scores(scores), ["item_id"], "no judgement")
    included = lambda v: F.size(F.filter(v, lambda t: t == INCLUDED))
    kept = x.select("ok", F.when(F.col("ok"), included(F.col("verdicts"))).alias("raw"), F.when(F.col("ok"), included(overlay_unknown(F.col("verdicts"), F.col("value_ok")))).alias("hybrid"), F.when(F.col("ok"), F.size("verdicts")).alias("total"), F.when(F.col("ok"), (F.col("wrong_statements") > 0) | F.array_contains("verdicts", WRONG)).alias("wrong"))
    return kept.agg(F.count_if(~F.col("ok")).alias("n_judge_failed"), S.ratio(F.sum("raw"), F.sum("total")).alias("raw_fact_recall"), S.ratio(F.sum("hybrid"), F.sum("total")).alias("hybrid_fact_recall"), S.ratio(F.count_if("wrong"), F.count_if("ok")).alias("wrong_rate"))


def overlay_unknown(verdicts: Column, value_ok: Column) -> Column:
    """``overlay`` where a fact without numeric values (NULL) keeps its verdict."""
    return overlay(verdicts, F.transform(value_ok, lambda v: F.coalesce(v, F.lit(True))), INCLUDED, MISSING)


def included_flags(verdicts: Column, n: Column) -> Column:
    """A rater's verdicts as booleans; a failed judgement (none) sees no error; another number than the facts' fails."""
    given = F.coalesce(verdicts, F.array().cast("array<string>"))
    flags = F.when(F.size(given) == 0, F.array_repeat(F.lit(True), n)).otherwise(F.transform(given, lambda v: v == INCLUDED))
    return F.when(F.size(flags) != n, F.raise_error(F.lit("as many verdicts as facts are needed"))).otherwise(flags)


def rated_facts(base: DataFrame, rater: DataFrame, key: str = "key") -> DataFrame:
    """A row for each fact: key, pos, a and b (whether each finds an error), failed. ``base`` and ``rater``: key, verdicts (and ok)."""
    other = unique(rater.select(key, F.col("verdicts").alias("_v"), (F.col("ok") if "ok" in rater.columns else F.lit(True)).alias("_ok")), [key])
    x = base.select(key, "verdicts").join(other, key, "left")
    n = F.size("verdicts")
    x = x.select(key, (~F.coalesce("_ok", F.lit(False)) | (F.size(F.coalesce("_v", F.array().cast("array<string>"))) == 0)).alias("failed"), F.arrays_zip(included_flags(F.col("verdicts"), n).alias("a"), included_flags(F.col("_v"), n).alias("b")).alias("f"))
    return x.select(key, "failed", F.posexplode("f").alias("pos", "f")).select(key, "failed", "pos", (~F.col("f.a")).alias("a"), (~F.col("f.b")).alias("b"))


def kappa_report(facts: DataFrame, key: str, n_boot: int, seed: str = "0") -> DataFrame:
    """One row: items, facts, errors of the base, failed judgements, kappa with its interval over items, error recall, false errors."""
    base = S.kappa_table(facts, [], "a", "b").select(F.col("n").alias("n_facts"), "kappa", "error_recall", "false_errors")
    sums = facts.agg(F.count_distinct(key).alias("n_items"), F.count_if("a").alias("n_errors"), F.count_distinct(F.when(F.col("failed"), F.col(key))).alias("n_failed"))
    return sums.crossJoin(base).crossJoin(S.kappa_bootstrap(S.rating_cells(facts, key, "a", "b"), key, n_boot, seed).select("low", "high"))  # one row each


def value_cells(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Facts by the value check (found, missed, no value) and the base rater's verdict, and the keys of facts where they disagree.

    ``rows``: key, verdicts, value_ok.
    """
    x = rows.select(*by, "key", F.posexplode(F.arrays_zip("verdicts", "value_ok")).alias("pos", "f")).withColumn("inc", F.col("f.verdicts") == INCLUDED).withColumn("ok", F.col("f.value_ok"))
    name = F.concat("key", F.lit("/F"), (F.col("pos") + 1).cast("string"))
    n, inc, ok = F.count_if, F.col("inc"), F.col("ok")
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, name)))
    return x.groupBy(*by).agg(
        n(ok & inc).alias("found_incl"), n(ok & ~inc).alias("found_not"), n(~ok & inc).alias("miss_incl"), n(~ok & ~inc).alias("miss_not"), n(ok.isNull() & inc).alias("noval_incl"), n(ok.isNull() & ~inc).alias("noval_not"),
        listed(~ok & inc).alias("missed_but_included"), listed(ok & ~inc).alias("found_but_not"),
    )
