"""Scores of parsed records against gold records, an item a row: counts, not ratios, so that any group of items can be summed again.

Everything is a Column expression over arrays, so an item's score needs no shuffle; only the small catalogue is joined.

A catalogue row has the labels of one domain: domain, kinds (map: entity type -> value kind), formats (map: id type -> form), categories,
actions, codes. A record is a struct of category, resolution, entities (array of struct(type, value)), actions_taken, follow_up
(struct(required, codes)), summary. Undefined ratios are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import scoring as S

CATALOGUE = "domain string, kinds map<string,string>, formats map<string,string>, categories array<string>, actions array<string>, codes array<string>"


def entity_keys(entities: Column, kinds: Column) -> Column:
    """Each entity's type and normalised value; the value is NULL if the type is unknown or the value unreadable."""
    return F.transform(entities, lambda e: F.struct(e["type"].alias("type"), F.when(kinds[e["type"]].isNotNull(), V.normalize(kinds[e["type"]], e["value"])).alias("norm")))


def matched(gold: Column, pred: Column) -> Column:
    """How many entries two arrays have in common as multisets."""
    times = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    return F.aggregate(F.array_distinct(pred), F.lit(0), lambda n, k: n + F.least(times(gold, k), times(pred, k)))


def off_list(record: Column, cat: Column) -> Column:
    """How many labels the catalogue does not have: category, distinct actions and codes, entity types (each entity counts)."""
    outside = lambda xs, allowed: F.size(F.array_except(xs, allowed))
    types = F.size(F.filter(record["entities"], lambda e: cat["kinds"][e["type"]].isNull()))
    return (~F.array_contains(cat["categories"], record["category"])).cast("int") + outside(record["actions_taken"], cat["actions"]) + outside(record["follow_up"]["codes"], cat["codes"]) + types


def unfound(entities: Column, kinds: Column, index: Column, spoken: Column) -> Column:
    """The entities whose value is not in the indexed text; an unknown type is looked for as text."""
    return F.filter(entities, lambda e: ~V.found_at(F.coalesce(kinds[e["type"]], F.lit("text")), e["value"], index, spoken))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def score_items(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The 20 columns of each item's score. ``items``: item_id, domain, gold (record), json_ok, schema_ok, record, transcript, spoken.

    A reply that failed its schema counts as nothing predicted: all gold entities and actions are missed and no flag is set.
    """
    kept = ("item_id", "domain", "gold", "json_ok", "schema_ok", "record", "transcript", "spoken")
    x = items.select(*kept).join(catalogue.select("domain", F.struct("kinds", "categories", "actions", "codes").alias("cat")), "domain")
    x = x.withColumn("good", F.coalesce(F.col("schema_ok"), F.lit(False)) & F.col("record").isNotNull()).withColumn("index", F.when(F.col("good"), V.text_index(F.col("transcript"))))
    cat, gold, pred, good = (F.col(c) for c in ("cat", "gold", "record", "good"))
    readable = lambda r: F.filter(entity_keys(r["entities"], cat["kinds"]), lambda k: k["norm"].isNotNull())
    x = x.withColumn("g", readable(gold)).withColumn("p", readable(pred)).withColumn("tp", matched(F.col("g"), F.col("p")))
    number = lambda when_good, otherwise=F.lit(0): F.when(good, when_good).otherwise(otherwise).cast("long")
    flag = lambda c: F.coalesce(good & c, F.lit(False))
    actions = F.array_distinct(gold["actions_taken"])
    scored = x.select(
        "item_id", "domain", gold["category"].alias("gold_category"), F.coalesce("json_ok", F.lit(False)).alias("json_ok"), good.alias("schema_ok"), F.when(good, pred["category"]).alias("pred_category"),
        flag(pred["category"] == gold["category"]).alias("category_ok"), flag(pred["resolution"] == gold["resolution"]).alias("resolution_ok"), number(F.col("tp")).alias("entity_tp"),
        number(F.size(pred["entities"]) - F.col("tp")).alias("entity_fp"), number(F.size("g") - F.col("tp"), F.size("g")).alias("entity_fn"), number(F.size(pred["entities"])).alias("entity_pred"),
        number(F.size(unfound(pred["entities"], cat["kinds"], F.col("index"), F.col("spoken")))).alias("entity_hallucinated"), number(F.size(F.array_intersect(pred["actions_taken"], actions))).alias("action_tp"),
        number(F.size(F.array_except(pred["actions_taken"], actions))).alias("action_fp"), number(F.size(F.array_except(actions, pred["actions_taken"])), F.size(actions)).alias("action_fn"),
        flag(pred["follow_up"]["required"] == gold["follow_up"]["required"]).alias("follow_required_ok"), flag(same_set(pred["follow_up"]["codes"], gold["follow_up"]["codes"])).alias("follow_codes_ok"),
        number(off_list(pred, cat)).alias("off_list"),
    )
    return scored.withColumn("exact", is_exact())


def is_exact() -> Column:
    """All structured fields right; the summary does not count."""
    flags = F.col("category_ok") & F.col("resolution_ok") & F.col("follow_required_ok") & F.col("follow_codes_ok")
    return flags & (F.col("entity_fp") + F.col("entity_fn") + F.col("action_fp") + F.col("action_fn") == 0)


def _rate(flag: str):
    return (flag, "n"), S.ratio


#: The metrics of item scores but for the macro F1: what is summed, and the ratio of the sums.
METRICS = {
    "json": _rate("json_ok"), "schema": _rate("schema_ok"), "exact": _rate("exact"), "category_acc": _rate("category_ok"), "resolution_acc": _rate("resolution_ok"),
    "entity_p": (("entity_tp", "entity_fp"), lambda tp, fp: S.ratio(tp, tp + fp)), "entity_r": (("entity_tp", "entity_fn"), lambda tp, fn: S.ratio(tp, tp + fn)),
    "entity_f1": (("entity_tp", "entity_fp", "entity_fn"), S.f1), "hallucination": (("entity_hallucinated", "entity_pred"), S.ratio), "action_f1": (("action_tp", "action_fp", "action_fn"), S.f1),
    "follow_up_acc": _rate("follow_ok"), "off_list": _rate("off_any"),
}
S.METRICS.update({f"item_{k}": v for k, v in METRICS.items()})


def countable(scores: DataFrame) -> DataFrame:
    """Scores with the two flags that only metrics use."""
    return scores.withColumn("follow_ok", F.col("follow_required_ok") & F.col("follow_codes_ok")).withColumn("off_any", F.col("off_list") > 0)


def summarise(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n and the 13 metrics of item scores, by group. Macro F1 is over the (domain, category) labels that gold has in the group."""
    point = S.evaluate(countable(scores), [f"item_{k}" for k in METRICS], by).toDF(*by, "n", *METRICS)
    labels = ["domain"]
    cols = [*by, *(c for c in labels if c not in by)]
    gold = scores.groupBy(*cols, F.col("gold_category").alias("label")).agg(F.count("*").alias("gold_n"), F.count_if("category_ok").alias("tp"))
    pred = scores.groupBy(*cols, F.col("pred_category").alias("label")).agg(F.count("*").alias("pred_n"))
    each = gold.join(pred, [*cols, "label"], "left").fillna(0, ["pred_n"]).withColumn("f1", S.f1(F.col("tp"), F.col("pred_n") - F.col("tp"), F.col("gold_n") - F.col("tp")))
    macro = each.groupBy(*by).agg(F.avg("f1").alias("category_macro_f1"))
    return point.join(macro, list(by), "left") if by else point.crossJoin(macro)  # one row each


def summary_table(scores: DataFrame) -> DataFrame:
    """The metrics of all items, of those whose reply passed the schema, and of each domain: (part, domain, n, metrics)."""
    whole = summarise(scores).select(F.lit("all").alias("part"), F.lit(None).cast("string").alias("domain"), "n", *METRICS, "category_macro_f1")
    passed = summarise(scores.filter("schema_ok")).select(F.lit("schema_ok_only").alias("part"), F.lit(None).cast("string").alias("domain"), "n", *METRICS, "category_macro_f1")
    return whole.unionByName(passed).unionByName(summarise(scores, ["domain"]).withColumn("part", F.lit("domain")))


def run_checks(replies: DataFrame, context: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Replies that were cut, that came with reasoning, or that filled the context (NULL if its size is unknown)."""
    full = F.lit(None).cast("long") if context is None else F.count_if(F.col("prompt_tokens") + F.col("completion_tokens") >= context)
    return replies.groupBy(*by).agg(F.count_if(F.col("done_reason") == "length").alias("length_stops"), F.count_if(F.col("thinking_chars") > 0).alias("thinking_items"), full.alias("context_full"))


def identifier_report(items: DataFrame, catalogue: DataFrame, written: dict[str, str]) -> DataFrame:
    """Each predicted identifier: item_id, pos, type, value, correct, reasons, written_ok, shape.

    ``items`` as for ``score_items`` (rows without a record give none). The k-th prediction of a value is correct if gold has it k
    times; reasons, in order: format, not_in_transcript. shape: how a wrong one without a reason differs from gold.
    """
    cat = catalogue.select("domain", F.struct("kinds", "formats").alias("cat"))
    x = items.filter("record IS NOT NULL").join(cat, "domain").withColumn("index", V.text_index(F.col("transcript")))
    kinds = F.col("cat")["kinds"]
    ids = lambda r: F.filter(r["entities"], lambda e: kinds[e["type"]] == "id")
    keyed = lambda xs: F.transform(xs, lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), V.normalize("id", e["value"]).alias("norm")))
    x = x.withColumn("g", keyed(ids(F.col("gold")))).withColumn("p", keyed(ids(F.col("record"))))
    same = lambda a, b: (a["type"] == b["type"]) & a["norm"].eqNullSafe(b["norm"])
    before = lambda e, i: F.size(F.filter(F.slice(F.col("p"), F.lit(1), i + 1), lambda o: same(o, e)))
    golds = lambda e: F.array_sort(F.array_distinct(F.transform(F.filter(F.col("g"), lambda o: (o["type"] == e["type"]) & o["norm"].isNotNull()), lambda o: o["norm"])))

    def judged(e: Column, i: Column) -> Column:
        form = F.col("cat")["formats"][e["type"]]
        odd = form.isNotNull() & ~F.coalesce(F.call_function("rlike", e["norm"], F.concat(F.lit("^(?:"), form, F.lit(")$"))), F.lit(False))
        reasons = F.filter(F.array(F.when(odd, "format"), F.when(~V.found_at(F.lit("id"), e["value"], F.col("index"), True), "not_in_transcript")), lambda r: r.isNotNull())
        correct = before(e, i) <= F.size(F.filter(F.col("g"), lambda o: same(o, e)))
        return F.struct(
            i.cast("long").alias("pos"), e["type"].alias("type"), e["value"].alias("value"), correct.alias("correct"), reasons.alias("reasons"), V.written_form_ok(e["type"], e["value"], written).alias("written_ok"),
            F.when(~correct & (F.size(reasons) == 0), V.number_shape(e["norm"], golds(e))).alias("shape"),
        )

    return x.select("item_id", F.inline(F.transform("p", judged)))


def identifier_flags(report: DataFrame) -> DataFrame:
    """Each item's flagged identifiers in record order: item_id, flags (array of struct(type, value, reasons))."""
    flagged = report.filter(F.size("reasons") > 0).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "value", "reasons"))).alias("f"))
    return flagged.select("item_id", F.transform("f", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["reasons"].alias("reasons"))).alias("flags"))


def guard_report(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Predicted identifiers by correct or wrong and flagged or not, and the unflagged whose written form is odd."""
    flagged, correct, n = F.size("reasons") > 0, F.col("correct"), F.count_if
    odd = ~F.array_contains("reasons", "format") & ~F.col("written_ok")
    return report.groupBy(*by).agg(
        F.count("*").alias("predicted"), n(correct).alias("correct"), n(~correct).alias("wrong"), n(correct & flagged).alias("flagged_correct"), n(~correct & flagged).alias("flagged_wrong"),
        n(odd & correct).alias("written_rule_correct"), n(odd & ~correct).alias("written_rule_wrong"),
    )


def missed_identifiers(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row: gold identifiers that a record lacks, and rows without a record."""
    x = items.join(catalogue.select("domain", "kinds"), "domain")
    keys = lambda r: F.transform(F.filter(r["entities"], lambda e: F.col("kinds")[e["type"]] == "id"), lambda e: F.concat_ws("\x1f", e["type"], F.coalesce(V.normalize("id", e["value"]), F.lit("\x1e"))))
    g, p = keys(F.col("gold")), keys(F.col("record"))
    return x.agg(F.coalesce(F.sum(F.when(F.col("record").isNotNull(), F.size(g) - matched(g, p))), F.lit(0)).cast("long").alias("gold_ids_not_predicted"), F.count_if(F.col("record").isNull()).alias("rows_without_record"))


def value_survival(items: DataFrame, catalogue: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(by type: values, found; items with all values found): of gold entities in the transcript. An item without any has all."""
    x = items.join(catalogue.select("domain", "kinds"), "domain").withColumn("index", V.text_index(F.col("transcript")))
    found = F.transform(F.col("gold")["entities"], lambda e: F.struct(e["type"].alias("type"), V.found_at(F.col("kinds")[e["type"]], e["value"], F.col("index"), F.col("spoken")).alias("found")))
    x = x.select(*by, "item_id", found.alias("v"))
    types = x.select(*by, F.inline("v")).groupBy(*by, "type").agg(F.count("*").alias("values"), F.count_if("found").alias("found"))
    return types, x.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(F.forall("v", lambda e: e["found"])).alias("all_found"))


def unfound_split(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Predicted values that the transcript lacks, by type: restored (gold has them) or invented, and how many are empty or placeholders."""
    x = items.filter("record IS NOT NULL").join(catalogue.select("domain", "kinds"), "domain").withColumn("index", V.text_index(F.col("transcript")))
    x = x.withColumn("g", entity_keys(F.col("gold")["entities"], F.col("kinds")))
    lost = x.select("g", "kinds", F.explode(unfound(F.col("record")["entities"], F.col("kinds"), F.col("index"), F.col("spoken"))).alias("e"))
    norm = F.when(F.col("kinds")[F.col("e.type")].isNotNull(), V.normalize(F.col("kinds")[F.col("e.type")], F.col("e.value")))
    restored = F.coalesce(norm.isNotNull() & F.exists("g", lambda k: (k["type"] == F.col("e.type")) & (k["norm"] == norm)), F.lit(False))
    empty = F.regexp_replace("e.value", r"(?U)\s", "") == ""
    return lost.groupBy(F.col("e.type").alias("type")).agg(
        F.count_if(restored).alias("restored"), F.count_if(~restored).alias("invented"), F.count_if(empty).alias("empty"), F.count_if(~empty & V.is_placeholder(F.col("e.value"))).alias("placeholder")
    )


def structure(record: Column, kinds: Column) -> Column:
    """A record without its summary as canonical JSON text: equal texts are equal records for the score."""
    key = F.transform(record["entities"], lambda e: F.to_json(F.struct(e["type"].alias("t"), F.when(kinds[e["type"]].isNotNull(), V.normalize(kinds[e["type"]], e["value"])).alias("n"), F.when(kinds[e["type"]].isNull() | V.normalize(kinds[e["type"]], e["value"]).isNull(), e["value"]).alias("raw"))))
    distinct = lambda xs: F.array_sort(F.array_distinct(xs))
    return F.to_json(F.struct(record["category"].alias("category"), record["resolution"].alias("resolution"), F.array_sort(key).alias("entities"), distinct(record["actions_taken"]).alias("actions"), record["follow_up"]["required"].alias("required"), distinct(record["follow_up"]["codes"]).alias("codes")))


def checked_structures(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``rows`` (item_id, domain, gold, record, exact) with wrong_structure: NULL where the record is right or there is none.

    Reading fails if a recorded ``exact`` does not agree with the structures.
    """
    x = rows.join(catalogue.select("domain", "kinds"), "domain")
    mine, right = structure(F.col("record"), F.col("kinds")), structure(F.col("gold"), F.col("kinds"))
    wrong = F.when(F.col("record").isNotNull() & (mine != right), mine)
    odd = F.when(F.col("record").isNull(), F.col("exact")).otherwise((mine == right) != F.col("exact"))
    return x.withColumn("wrong_structure", F.when(odd, F.raise_error(F.concat(F.lit("recorded exact does not agree with the record: "), "item_id"))).otherwise(wrong)).drop("kinds")
