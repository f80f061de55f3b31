"""Transcripts, quality rules and their reports, noisy copies, cross-run audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V


def transcripts(turns: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """One row for each conversation: ordered turns and the text 'speaker: text' by line."""
    listed = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(speaker).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("turns"))
    return listed.withColumn("transcript", F.array_join(F.transform("turns", lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n"))


def same_in_row(turns: Column) -> Column:
    """How often a speaker speaks twice in a row."""
    pairs = F.filter(F.sequence(F.lit(1), F.size(turns) - 1), lambda i: F.get(turns, i)["speaker"] == F.get(turns, i - 1)["speaker"])
    return F.when(F.size(turns) < 2, 0).otherwise(F.size(pairs))


# The problems' texts below, and their order, are fixed values.
def dialogue_problems(turns: Column, speakers: Sequence[str], least: int = 8, most: int = 40, pairs: int = 2) -> Column:
    """What makes a dialogue unusable. Without turns only their number is named; a bad or empty turn ends the list."""
    names = F.array(*map(F.lit, speakers))
    count = F.when(~F.size(turns).between(least, most), F.concat(F.lit("turn count "), F.size(turns).cast("string")))
    bad = F.exists(turns, lambda t: ~F.array_contains(names, t["speaker"]) | (F.regexp_replace(t["text"], r"(?U)\s", "") == ""))
    text, row = F.array_join(F.transform(turns, lambda t: t["text"]), "\n"), same_in_row(turns)
    rest = F.array(
        count,
        F.when(F.get(turns, F.lit(0))["speaker"] != speakers[0], "does not start with the agent"),
        F.when(F.size(F.array_distinct(F.transform(turns, lambda t: t["speaker"]))) < len(speakers), "one speaker only"),
        F.when(row > pairs, F.concat(row.cast("string"), F.lit(" consecutive same-speaker turns"))),
        F.when(V.foreign_script(text), "non-Korean script (Han/kana)"),
    )
    early = F.array(count, F.lit("bad speaker or empty turn"))
    return F.filter(F.when(F.size(turns) == 0, F.array(count)).when(bad, early).otherwise(rest), lambda p: p.isNotNull())


def verification_problem(text: Column, asked: Column) -> Column:
    """Whether verification is spoken of where the spec has none, or the other way round; NULL if they agree."""
    spoken = V.verification_words(text)
    return F.when(spoken & ~asked, "verification not in spec").when(~spoken & asked, "spec verification missing")


def summary_problems(summary: Column, slots: Column, distractor: Column) -> Column:
    """What makes a reference summary unusable. ``slots``: array of struct(kind, type, value); ``distractor``: the number first said wrongly."""
    index, n = V.text_index(summary), V.sentence_count(summary)
    fits = n.between(2, 8) & F.length(summary).between(40, 600)
    missing = F.transform(F.filter(slots, lambda s: ~V.found_at(s["kind"], s["value"], index)), lambda s: F.concat(F.lit("summary misses "), s["type"], F.lit(" '"), s["value"], F.lit("'")))
    first = F.array(F.when(V.foreign_script(summary), "non-Korean script (Han/kana)"), F.when(~fits, F.concat(F.lit("length ("), F.length(summary).cast("string"), F.lit(" chars)"))))
    last = F.array(F.when(F.coalesce(V.found_at(F.lit("id"), distractor, index), F.lit(False)), "summary repeats the corrected value"))
    return F.filter(F.concat(first, missing, last), lambda p: p.isNotNull())


def value_problems(text: Column, slots: Column) -> Column:
    """Values of the spec that the text misses (letter by letter) and typed values that are not the spec's.

    ``slots``: array of struct(kind, type, value). An amount that ends an allowed one is no new value.
    """
    missing = F.transform(F.filter(slots, lambda s: ~text.contains(s["value"])), lambda s: F.concat(F.lit("missing "), s["type"], F.lit(" '"), s["value"], F.lit("'")))
    none = F.array().cast("array<string>")

    def extra_values(kind: str) -> Column:
        own = F.filter(slots, lambda s: s["kind"] == kind)
        allowed = F.filter(F.transform(own, lambda s: V.normalize(kind, s["value"])), lambda v: v.isNotNull())
        extra = F.array_sort(F.array_except(V.values_in(kind, text), allowed))
        if kind == "amount":
            extra = F.filter(extra, lambda v: ~F.exists(allowed, lambda x: x.endswith(v)))
        return F.when(F.size(extra) > 0, F.array(F.concat(F.lit(f"extra {kind} ["), F.array_join(extra, ", "), F.lit("]")))).otherwise(none)

    out = F.concat(missing, *map(extra_values, ("amount", "date", "time")))
    ids = F.transform(F.filter(slots, lambda s: s["kind"] == "id"), lambda s: V.norm_id(s["value"]))
    odd = F.filter(V.id_like(text), lambda x: ~F.exists(ids, lambda a: a.contains(V.norm_id(x))))
    return F.concat(out, F.transform(odd, lambda x: F.concat(F.lit("extra id '"), x, F.lit("'"))))


def reason_class(problem: Column) -> Column:
    """A problem without its particulars: cut at a bracket or at a quoted value, numbers dropped from its start."""
    cut = F.regexp_replace(problem, r"\s*(\[|\(| ').*$", "")
    return F.trim(F.regexp_replace(cut, r"^\d+ | \d+$", ""))


def rejection_report(rows: DataFrame, problems: str) -> DataFrame:
    """Rows by reason class, most first."""
    return rows.select(F.explode(problems).alias("p")).groupBy(reason_class(F.col("p")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def identifier_flags(kind_ok: Column, norm: Column, pattern: Column, found: Column) -> Column:
    """Reasons to check an identifier: its form and its absence from the text."""
    formed = F.coalesce(F.call_function("rlike", norm, F.concat(F.lit("^(?:"), pattern, F.lit(")$"))), F.lit(False))
    return F.filter(F.array(F.when(kind_ok & ~formed, "format"), F.when(kind_ok & ~found, "not in transcript")), lambda r: r.isNotNull())


def error_rate(rows: DataFrame, by: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """Edit distance over reference length, by group."""
    sums = rows.groupBy(*by).agg(F.sum(F.levenshtein(F.col(ref), F.col(hyp)).cast("long")).alias("edits"), F.sum(F.length(ref).cast("long")).alias("chars"))
    return sums.withColumn("cer", F.try_divide(F.col("edits").cast("double"), F.col("chars").cast("double")))


def wrong_digit_runs(written: Column, heard: Column) -> Column:
    """Heard runs of four digits or more that are neither a written run nor a written amount; repeats count."""
    said = F.concat(V.digit_runs(written), V.amounts_in(written))
    return F.size(F.filter(V.digit_runs(heard), lambda r: (F.length(r) >= 4) & ~F.array_contains(said, r))).cast("long")


def identity(turns: DataFrame, other: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """How many turns a second copy has: same, different, missing."""
    both = turns.select(*keys, F.col(text).alias("x")).join(other.select(*keys, F.col(text).alias("y"), F.lit(1).alias("there")), list(keys), "left")
    there = F.col("there").isNotNull()
    count = lambda c: F.count_if(c)
    return both.agg(F.count("*").alias("turns"), count(there & F.col("x").eqNullSafe(F.col("y"))).alias("same"), count(there & ~F.col("x").eqNullSafe(F.col("y"))).alias("different"), count(~there).alias("missing"))


def consensus(rows: DataFrame, item: str, structure: Column, group: str, run: str, least_groups: int) -> DataFrame:
    """Wrong structures by item: which groups and runs gave each, and whether enough groups agree."""
    each = rows.withColumn("structure", structure).groupBy(item, "structure").agg(F.count_distinct(group).alias("groups"), F.count_distinct(run).alias("runs"))
    return each.withColumn("agreed", F.col("groups") >= least_groups)


def overlay(verdicts: Column, ok: Column, included: str, missing: str) -> Column:
    """Verdicts with included turned to missing where the value check is false; lengths must agree, none counts as all included."""
    start = F.when(F.size(verdicts) == 0, F.array_repeat(F.lit(included), F.size(ok))).otherwise(verdicts)
    turned = F.zip_with(start, ok, lambda v, o: F.when((v == included) & ~o, missing).otherwise(v))
    return F.when(F.size(start) != F.size(ok), F.raise_error(F.lit("as many verdicts as checks are needed"))).otherwise(turned)
