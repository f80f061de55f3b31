"""Seeded generation and counterfactual copies of dialogues. Each row is made from its own seed text, so rows can be made anywhere, in any
order, and again after a lost executor. These run as Arrow batches (``mapInPandas``): they need callbacks and retries."""

from __future__ import annotations

import difflib
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIES, SLOT_TRIES = 100, 50
SPEC = (
    "item_id string, scenario string, outcome string, slots array<struct<slot:string,type:string,value:string>>, distractor string, extra_turn boolean, events array<string>, actions array<string>, facts array<string>"
)
TURNS = "array<struct<speaker:string,text:string>>"


def make_value(rng: random.Random, kind: str, form: str) -> str:
    """A value of a kind. ``form``: a template for ids (# is a digit), 'low-high-step' for amounts, options joined by | for texts."""
    if kind == "id":
        return "".join(str(rng.randrange(10)) if c == "#" else c for c in form)
    if kind == "amount":
        low, high, step = map(int, form.split("-"))
        n = rng.randrange(low, high + 1, step)
        high, low = divmod(n, 10_000)
        if not high or rng.random() < 0.5:
            return f"{n:,}원"
        return f"{high}만 원" if not low else f"{high}만 {low // 1000}천 원" if low % 1000 == 0 else f"{high}만 {low:,}원"
    if kind == "date":
        return f"{rng.randint(1, 12)}월 {rng.randint(1, 28)}일"
    if kind == "time":
        return f"{rng.choice(['오전', '오후'])} {rng.randint(1, 11)}시{rng.choice(['', '', ' 30분'])}"
    return rng.choice(form.split("|"))


def month_day(value: str) -> tuple[int, ...]:
    return tuple(map(int, re.findall(r"\d+", value)))


def make_spec(item: str, scenario: str, plan: dict, seed: str) -> tuple:
    """One row of ``sample_specs``: outcome by weight, distinct slot values, dates in order, events, a number first said wrongly, facts."""
    rng = random.Random(f"{seed}:{item}:{scenario}")
    outcome = rng.choices(list(plan["outcomes"]), list(plan["outcomes"].values()))[0]
    slots, used = {}, set()
    for slot, label, kind, form in plan["slots"]:
        value = next((v for v in (make_value(rng, kind, form) for _ in range(SLOT_TRIES)) if (label, v) not in used), None)
        if value is None:
            raise ValueError(f"no distinct value for {slot} in {SLOT_TRIES} tries")
        used.add((label, value))
        slots[slot] = [label, value]
    for first, later in plan.get("ordered", ()):
        if first in slots and later in slots and month_day(slots[first][1]) > month_day(slots[later][1]):
            slots[first][1], slots[later][1] = slots[later][1], slots[first][1]
    events = [e for e, p in plan.get("events", {}).items() if rng.random() < p]
    ids = [slots[p[0]][1] for p in plan["slots"] if p[2] == "id"]
    wrong = change_one_digit(rng, rng.choice(ids)) if ids and rng.random() < plan["distractor"] else None
    facts = [f.format(**{k: v for k, (_, v) in slots.items()}) for f in plan.get("facts", ())]
    return (item, scenario, outcome, [{"slot": k, "type": t, "value": v} for k, (t, v) in slots.items()], wrong, rng.random() < plan["extra"], events, [*(["본인 확인"] if "verify" in events else []), *plan.get("actions", {}).get(outcome, ())], facts)


def sample_specs(keys: DataFrame, catalogue: dict, seed: str) -> DataFrame:
    """Specs for ``keys`` (item_id, scenario). ``catalogue``: scenario -> {"outcomes": {name: weight}, "slots": [(slot, type, kind, form)],
    "extra": probability, "distractor": probability} and, if wanted, "ordered": pairs of date slots, "events": {name: probability},
    "actions": {outcome: [...]}, "facts": templates of slots. The same key and seed always give the same spec."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [make_spec(item, scenario, catalogue[scenario], seed) for item, scenario in zip(b["item_id"], b["scenario"], strict=True)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in re.split(r", (?=\w+ (?:string|array|boolean))", SPEC)])

    return keys.select("item_id", "scenario").mapInPandas(run, SPEC)


def change_one_digit(rng: random.Random, value: str) -> str:
    """The value with one digit replaced by another."""
    at = rng.choice([i for i, c in enumerate(value) if c.isdigit()])
    return value[:at] + str((int(value[at]) + rng.randint(1, 9)) % 10) + value[at + 1 :]


def fours(value: str) -> set[str]:
    """All runs of four digits of a value."""
    digits = re.sub(r"\D", "", value)
    return {digits[i : i + 4] for i in range(len(digits) - 3)}


def new_numbers(text: str, values: list[str], rng: random.Random) -> dict[str, str] | None:
    """A new number of the same form for each value, such that no four digits in a row stand in the text or in another new one; None if
    ``TRIES`` tries do not do."""
    taken = set().union(*(fours(r) for r in re.findall(r"\d+(?:[ \-]\d+)*", text))) if text else set()
    out = {}
    for v in values:
        for _ in range(TRIES):
            new = "".join(str(rng.randrange(10)) if c.isdigit() else c for c in v)
            if new != v and not fours(new) & taken:
                break
        else:
            return None
        out[v] = new
        taken |= fours(new)
    return out


def swap_numbers(dialogues: DataFrame, seed: str) -> DataFrame:
    """Dialogues (item_id, turns, values) with every value replaced by a new number in all turns, the particle behind it made to agree:
    turns, old and new values, ok, tries, replaced, particles. A try that leaves four digits of an old number anywhere is made again;
    ok is false if ``TRIES`` tries do not do, and then nothing is changed."""
    from ..functions.speech import swap_values

    def one(item: str, turns: list, values: list[str]) -> tuple:
        texts = [t["text"] or "" for t in turns]
        rng = random.Random(f"swap:{seed}:{item}")
        for n in range(1, TRIES + 1):
            pairs = new_numbers("\n".join(texts), values, rng)
            if pairs is None:
                break
            done = [swap_values(t, list(pairs.items())) for t in texts]
            runs = [re.sub(r"\D", "", r) for t, _, _ in done for r in re.findall(r"\d+(?:[ \-]\d+)*", t)]
            if not any(w in r for v in values for w in fours(v) for r in runs):
                said = [{"speaker": t["speaker"], "text": d[0]} for t, d in zip(turns, done, strict=True)]
                return said, [pairs[v] for v in values], True, n, sum(d[1] for d in done), sum(d[2] for d in done)
        return list(turns), [None] * len(values), False, n, 0, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, turns, values in zip(b["item_id"], b["turns"], b["values"], strict=True):
                values = sorted(values, key=lambda v: (-len(v), v))
                said, new, *rest = one(item, list(turns), values)
                out.append((item, said, values, new, *rest))
            yield pd.DataFrame(out, columns=["item_id", "turns", "old", "new", "ok", "tries", "replaced", "particles"])

    return dialogues.select("item_id", "turns", "values").mapInPandas(run, f"item_id string, turns {TURNS}, old array<string>, new array<string>, ok boolean, tries int, replaced int, particles int")


def insert_neutral(dialogues: DataFrame, lines: dict[str, list[tuple[str, str]]], seed: str) -> DataFrame:
    """Dialogues with two or four turns without values put in where the speaker changes, not between the first two turns; ``at`` is where
    (-1: nowhere, then nothing is put in), ``inserted`` how many. ``lines``: first speaker -> (what it says, the other's answer), each
    used once at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, turns in zip(b["item_id"], b["turns"], strict=True):
                rng, turns = random.Random(f"neutral:{seed}:{item}"), list(turns)
                places = [i for i in range(2, len(turns)) if turns[i]["speaker"] != turns[i - 1]["speaker"] and lines.get(turns[i]["speaker"])]
                at, put = (rng.choice(places) if places else -1), []
                if places:
                    pair = (turns[at]["speaker"], turns[at - 1]["speaker"])
                    for texts in rng.sample(lines[pair[0]], min(rng.choice((1, 2)), len(lines[pair[0]]))):
                        put += [{"speaker": s, "text": t} for s, t in zip(pair, texts, strict=True)]
                    turns[at:at] = put
                out.append((item, turns, at, len(put)))
            yield pd.DataFrame(out, columns=["item_id", "turns", "at", "inserted"])

    return dialogues.select("item_id", "turns").mapInPandas(run, f"item_id string, turns {TURNS}, at int, inserted int")


def still_valid(altered: DataFrame, problems: Column) -> DataFrame:
    """Altered dialogues with their problems by the dialogue rules; reading fails where there are any."""
    broken = F.when(F.size(problems) > 0, F.raise_error(F.concat(F.lit("the altered turns broke the dialogue rules: "), F.col("item_id"), F.lit(" "), F.array_join(problems, "; "))))
    return altered.filter(broken.isNull())


def for_variants(items: DataFrame) -> DataFrame:
    """The items that may be altered; reading fails on one of another split than dev, or one that is altered already."""
    odd = (F.col("split") != "dev") | F.col("altered")
    return items.filter(F.when(odd, F.raise_error(F.concat(F.lit("not an unaltered dev item: "), F.col("item_id")))).otherwise(F.lit(True)))


def inject_target(form: Column, resolution: Column, category: Column, categories: Column, amounts: Column, choices: list[tuple[str, str]]) -> Column:
    """A wrong value that differs from gold: another resolution, another category, an amount that the dialogue does not have (NULL if all
    are there). ``choices``: (normalised, as written) amounts."""
    other = F.filter(categories, lambda c: c != category)
    new = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in choices)), lambda a: ~F.array_contains(amounts, a["n"]))
    return F.when(form == "resolution", F.when(resolution == "해결", "미해결").otherwise("해결")).when(form == "category", F.get(other, F.lit(0))).otherwise(F.get(new, F.lit(0))["w"])


def inject(turns: Column, instruction: Column, refusal: str, speakers: tuple[str, str]) -> Column:
    """An instruction of the caller and the agent's refusal, before the last two turns."""
    pair = F.array(F.struct(F.lit(speakers[1]).alias("speaker"), instruction.alias("text")), F.struct(F.lit(speakers[0]).alias("speaker"), F.lit(refusal).alias("text")))
    head = F.greatest(F.size(turns) - 2, F.lit(0))
    return F.concat(F.slice(turns, F.lit(1), head), pair, F.slice(turns, head + 1, F.lit(2)))


def aligned(written: str | None, heard: str | None, number: str | None, at: int = 0) -> str | None:
    """What a noisy copy has where the written text has the number (its first place from ``at`` on), with the digits beside it; NULL if it
    is not written."""
    if None in (written, heard, number) or (start := written.find(number, at)) < 0:
        return None
    end, places = start + len(number), []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, written, heard, autojunk=False).get_opcodes():
        low, high = max(a, start), min(b, end)
        if low < high or (a == b and start < a < end):
            places += [c + low - a, c + high - a] if tag == "equal" else [c, d]
    if not places:
        return ""
    before, inside, after = heard[: min(places)], heard[min(places) : max(places)], heard[max(places) :]
    return re.search(r"\d*$", before)[0] + inside + re.match(r"\d*", after)[0]


def heard_span(written: Column, heard: Column, number: Column) -> Column:
    run = F.pandas_udf(lambda a, b, c: pd.Series([aligned(x, y, z) for x, y, z in zip(a, b, c, strict=True)], dtype=object), "string")
    return run(written, heard, number)


# The forms in which a spoken number arrives.
FORMS = ("as_written", "split_found", "hangul_digit_names", "lost_hangul", "lost_fewer", "lost_more", "lost_changed")


def tracking_report(turns: DataFrame, pattern: str = r"\d{4}-\d{4}-\d{4}") -> tuple[DataFrame, DataFrame]:
    """(form, n) with 0 for forms that do not occur, and the lost numbers (item_id, number, form, span). ``turns``: item_id, written, heard."""
    x = turns.withColumn("number", F.explode(F.regexp_extract_all("written", F.lit(pattern), F.lit(0))))
    x = x.withColumn("form", tracking_form(F.col("written"), F.col("heard"), F.col("number")))
    every = turns.sparkSession.createDataFrame([(f,) for f in FORMS], "form string")
    counts = every.join(x.groupBy("form").agg(F.count("*").alias("n")), "form", "left").fillna(0, ["n"])
    return counts, x.filter(F.col("form").startswith("lost_")).select("item_id", "number", "form", heard_span(F.col("written"), F.col("heard"), F.col("number")).alias("span"))


def tracking_form(written: Column, heard: Column, number: Column) -> Column:
    """How a spoken number arrived: as written, split but found, as digit names, or lost in one of four ways."""
    from ..functions import values as V

    span = heard_span(written, heard, number)
    digits = lambda c: F.length(F.regexp_replace(c, r"(?U)\D", ""))
    return (
        F.when(heard.contains(number), "as_written").when(V.occurs("id", number, heard, True), "split_found").when(heard.rlike("[공영일이삼사오육칠팔구]{4}"), "hangul_digit_names")
        .when(F.replace(span, F.lit("에서"), F.lit("")).rlike("[가-힣]"), "lost_hangul").when(digits(span) < digits(number), "lost_fewer").when(digits(span) > digits(number), "lost_more").otherwise("lost_changed")
    )
