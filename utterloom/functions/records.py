"""Strict reading of JSON replies and a few text rewrites that need Python (Arrow UDFs, a batch at a time)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes of a call.
RESOLUTIONS = ("해결", "부분 해결", "미해결", "이관")

RECORD = "category string, resolution string, entities array<struct<type:string,value:string>>, actions_taken array<string>, follow_up struct<required:boolean,codes:array<string>>, summary string"
RECORD_KEYS = ("category", "resolution", "entities", "actions_taken", "follow_up", "summary")


def balanced_span(text: str | None) -> str | None:
    """The first {...} that closes; braces in JSON strings do not count, a start that never closes is passed over.

    Every start reads on as if outside a string. All that are outside, and all that are inside one, at a place read alike from there
    on, so one pass follows them all: ``waiting`` has, for both, the first open start of each level.
    """
    if text is None:
        return None
    waiting: dict[bool, dict[int, int]] = {False: {}, True: {}}
    level, escaped, best = {False: 0, True: 0}, -1, None
    for m in re.finditer(r'[{}"\\]', text):
        at, mark = m.start(), m[0]
        if mark == "\\":
            escaped = at + 1 if at != escaped else -1
        elif mark == '"':
            if at != escaped:
                waiting, level = ({q: x[not q] for q in x} for x in (waiting, level))
            else:  # of those inside a string nothing changes, the others enter one here
                few, many = sorted((False, True), key=lambda q: len(waiting[q]))
                for k, start in waiting[few].items():
                    k += level[many] - level[few]
                    waiting[many][k] = min(start, waiting[many].get(k, start))
                waiting, level = {False: {}, True: waiting[many]}, {False: 0, True: level[many]}
        elif mark == "{":
            level[False] += 1
            waiting[False][level[False]] = at
        else:
            start = waiting[False].pop(level[False], None)
            level[False] -= 1
            if start is not None and (best is None or start < best[0]):
                best = (start, at + 1)
    return text[slice(*best)] if best else None


def json_span(text: Column) -> Column:
    run = F.pandas_udf(lambda s: s.map(balanced_span), "string")
    return run(text)


def _only(keys: Column, allowed: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))) == 0


def parse_record(span: Column) -> Column:
    """struct(json_ok, schema_ok, record, error) of a JSON span; unknown keys fail at every level."""
    record = F.from_json(span, RECORD, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(span)
    follow = F.get_json_object(span, "$.follow_up")
    entities = F.from_json(F.get_json_object(span, "$.entities"), "array<map<string,string>>")
    whole = keys.isNotNull()
    needed = record["category"].isNotNull() & record["resolution"].isin(*RESOLUTIONS) & record["summary"].isNotNull() & record["follow_up"]["required"].isNotNull()
    strict = _only(keys, RECORD_KEYS) & _only(F.json_object_keys(follow), ("required", "codes"))
    plain = F.coalesce(F.forall(entities, lambda e: (F.size(F.map_keys(e)) == 2) & e["type"].isNotNull() & e["value"].isNotNull()), F.get_json_object(span, "$.entities").isNull())
    ok = F.coalesce(whole & needed & strict & plain, F.lit(False))
    return F.struct(
        F.coalesce(whole, F.lit(False)).alias("json_ok"), ok.alias("schema_ok"), F.when(ok, record).alias("record"),
        F.when(span.isNull(), "no JSON object").when(~F.coalesce(whole, F.lit(False)), "invalid JSON").when(~ok, "schema").alias("error"),
    )


def json_value(text: Column, key: str) -> Column:
    """A key of the text as JSON, else of what stands from its first { to its last }."""
    path = f"$.{key}"
    return F.coalesce(F.get_json_object(text, path), F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), path))


def parse_verdicts(text: Column, n: Column, allowed: tuple[str, ...]) -> Column:
    """struct(ok, verdicts, wrong): the list has n entries of the allowed set and the count is not negative."""
    got = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "verdicts array<string>, wrong int")
    good = (F.size(got["verdicts"]) == n) & F.forall(got["verdicts"], lambda v: v.isin(*allowed)) & (got["wrong"] >= 0)
    good = F.coalesce(good, F.lit(False))
    return F.struct(good.alias("ok"), F.when(good, got["verdicts"]).otherwise(F.array().cast("array<string>")).alias("verdicts"), F.when(good, got["wrong"]).otherwise(0).alias("wrong"))


def letters_only(text: Column) -> Column:
    """NFKC, then letters of the Latin alphabet, digits and Hangul syllables, upper-case: what an error rate is counted on."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else re.sub("[^0-9A-Za-z가-힣]", "", unicodedata.normalize("NFKC", x)).upper())

    return F.pandas_udf(run, "string")(text)
