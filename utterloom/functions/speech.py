"""Numbers between their written and their spoken form (Arrow UDFs: each text is scanned once, with look-around)."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of digits and letters that begin an identifier, with its length; lengths of identifiers; particles.
DIGIT_NAMES = {"공": "0", "영": "0", "일": "1", "이": "2", "삼": "3", "사": "4", "오": "5", "육": "6", "칠": "7", "팔": "8", "구": "9"}
PREFIXES = {"디": ("D", 7), "D": ("D", 7), "알": ("R", 6), "R": ("R", 6)}
ID_LENGTHS = frozenset({4, 6, 7, 12})
SAID = "공일이삼사오육칠팔구"
#: Final sound of a digit's name: none, ㄹ, or another one.
NO_FINAL, FINAL_R = frozenset("2459"), frozenset("178")
PARTICLES = (("이에요", "예요"), ("이라는", "라는"), ("이라고", "라고"), ("이야", "야"), ("이요", "요"), ("이", "가"), ("을", "를"), ("은", "는"), ("과", "와"))
COPULA = (("이었", "였"), ("이고", "고"))
PARTICLE = "이에요|이라는|이라고|으로|이었|예요|라는|라고|로|였|(?:이야|이요|이고|이|가|을|를|은|는|과|와|야|요|고)(?![가-힣])"
TRACKING = r"\d{4}-\d{4}-\d{4}"
ANY_ID = r"D\d{7}|R\d{6}|\d{4}-\d{4}-\d{4}"


class Cell(NamedTuple):
    """A digit or digit name of a run: where it stands, and the separator before it ("" for none)."""

    at: int
    char: str
    gap: str

    @property
    def name(self) -> bool:
        return self.char in DIGIT_NAMES


def _hangul(c: str) -> bool:
    return "가" <= c <= "힣"


def _digit(c: str) -> bool:
    return c in DIGIT_NAMES or (c.isascii() and c.isdigit())


def _cells(text: str, at: int) -> list[Cell]:
    """The run that begins at ``at``: digits with at most one separator (comma, comma and blank, blank, full stop, hyphen) between two."""
    out, gap = [], ""
    while at < len(text) and _digit(text[at]):
        out.append(Cell(at, text[at], gap))
        at += 1
        gap = next((g for g in (", ", ",", " ", ".", "-") if text.startswith(g, at) and at + len(g) < len(text) and _digit(text[at + len(g)])), "")
        at += len(gap)
    return out


def _next_word(run: list[Cell], after: str, lengths: frozenset[int]) -> int:
    """A digit apart, with a syllable right behind it, begins the next word."""
    return int(bool(run[-1].gap) and _hangul(after))


def _particle_apart(run: list[Cell], after: str, lengths: frozenset[int]) -> int:
    """이 apart is a particle, unless only with it the run has an identifier's length."""
    wanted = len(run) in lengths and len(run) - 1 not in lengths
    return int(bool(run[-1].gap) and run[-1].char == "이" and not wanted)


def _particle_joined(run: list[Cell], after: str, lengths: frozenset[int]) -> int:
    """이구 before 요, or 이 before any syllable, joined to both sides; else the one 이 too many for an identifier."""
    if _hangul(after):
        if after == "요" and len(run) > 2 and run[-2].char + run[-1].gap + run[-1].char == "이구":
            return 2
        if run[-1].char == "이" and len(run) > 1:
            return 1
    return int(run[-1].char == "이" and len(run) > 1 and len(run) not in lengths and len(run) - 1 in lengths)


#: What the end of a run may have swallowed, asked once each in this order.
ENDS = (_next_word, _particle_apart, _particle_joined)


def _without_end(run: list[Cell], after: str, lengths: frozenset[int]) -> list[Cell]:
    for drop in ENDS:
        k = drop(run, after, lengths)
        if k:
            after, run = run[-k].gap[:1] or run[-k].char, run[:-k]
            if drop is _particle_joined:
                break
    return run


def _has_day(run: list[Cell]) -> bool:
    """One or two written digits right before 일."""
    written = 0
    for c in run:
        if c.gap:
            written = 0
        if c.char == "일" and written in (1, 2):
            return True
        written = 0 if c.name else written + 1
    return False


def _is_identifier(run: list[Cell]) -> bool:
    names = sum(c.name for c in run)
    return names >= 4 if names == len(run) else bool(names) and len(run) >= 6 and not _has_day(run)


def _written(run: list[Cell], gaps: bool = True) -> str:
    return "".join((c.gap if gaps and k else "") + DIGIT_NAMES.get(c.char, c.char) for k, c in enumerate(run))


def digits_of_spoken_ids(text: str | None) -> str | None:
    """Identifiers read digit by digit, in digits; amounts, dates and words keep their form.

    A run of names and digits is one if all of it is names (four at least), or names and digits are mixed (six at least) and no
    day of a month stands in it. A letter (or its name) before it is its first letter if the count of digits is that identifier's;
    then the separators go. Words that the run's ends have swallowed stay as they are.
    """
    if text is None:
        return None
    out, done, at = [], 0, 0
    while at < len(text):
        free = at == 0 or not (_hangul(text[at - 1]) or (text[at - 1].isascii() and text[at - 1].isalnum()))
        begin = at
        if free and text[at] in PREFIXES:
            begin = at + 1 + (text[at + 1 : at + 2] == " ")
        run = _cells(text, begin) if free and begin < len(text) else []
        if not run:
            at += 1
            continue
        end = run[-1].at + 1
        after = text[end : end + 1]
        new = None
        if begin > at:
            letter, length = PREFIXES[text[at]]
            kept = _without_end(run, after, frozenset({length}))
            if len(kept) == length:
                new = letter + _written(kept, gaps=False) + text[kept[-1].at + 1 : end]
        elif len(run) > 2 and run[0].name and run[1].gap and not run[2].gap:  # a word before the number
            run = run[1:]
        if new is None:
            kept = _without_end(run, after, ID_LENGTHS)
            if kept and _is_identifier(kept):
                new = text[at : run[0].at] + _written(kept) + text[kept[-1].at + 1 : end]
        if new is not None:
            out += [text[done:at], new]
            done = end
        at = end
    return "".join(out) + text[done:]


def _per_text(f, kind: str = "string"):
    return F.pandas_udf(lambda s: s.map(f, na_action="ignore"), kind)


def spoken_ids(text: Column) -> Column:
    return _per_text(digits_of_spoken_ids)(text)


def says_identifier(text: Column) -> Column:
    """Whether a written text (of NFKC letters) names an identifier."""
    return text.rlike(rf"(?<![0-9A-Za-z\-])(?:{ANY_ID})(?![0-9A-Za-z\-])")


def spell_ids(text: str) -> str:
    """Numbers of three groups of four, digit by digit with commas between the groups; a text without one stays as it is."""
    norm = unicodedata.normalize("NFKC", text)
    said = re.sub(TRACKING, lambda m: " " + m[0].translate({**{ord(str(k)): c for k, c in enumerate(SAID)}, ord("-"): ", "}) + " ", norm, flags=re.ASCII)
    return text if said == norm else said


def spelled(text: Column) -> Column:
    return _per_text(spell_ids)(text)


# Sino-Korean and native numerals, and the counters that take native ones.
SINO = ("", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구")
NATIVE_TENS = ("", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔")
NATIVE_ONES = ("", "한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉")


def sino(n: int) -> str:
    """Sino-Korean reading; one is not said before ten, hundred, thousand, nor before a lone ten thousand."""
    if n == 0:
        return "영"
    groups, rest = [], str(n)
    for big in ("", "만", "억", "조"):
        part, rest = int(rest[-4:] or 0), rest[:-4]
        if part:
            said = "".join((SINO[int(d)] if d != "1" or not unit else "") + unit for d, unit in zip(f"{part:04d}", ("천", "백", "십", ""), strict=True) if d != "0")
            groups.insert(0, ("" if part == 1 and big == "만" else said) + big)
        if not rest:
            break
    return " ".join(groups)


def native(n: int) -> str:
    """The counting form of 1 to 99; Sino-Korean beyond."""
    if not 0 < n < 100:
        return sino(n)
    return "스무" if n == 20 else NATIVE_TENS[n // 10] + NATIVE_ONES[n % 10]


def say_numbers(text: str, counters: tuple[str, ...] = ("시", "개", "명", "번", "살", "건")) -> str:
    """Dates, clock times, long identifiers, percentages, counted and plain numbers as they are said; other signs become blanks.

    A number of five digits or more without thousands separators, or one that begins with 0, is read digit by digit unless 원 follows.
    """
    text = spell_ids(unicodedata.normalize("NFKC", text))

    def one(m: re.Match[str]) -> str:
        if m["hour"]:
            return native(int(m["hour"])) + " 시" + (f" {sino(int(m['minute']))} 분" if int(m["minute"]) else "")
        whole, unit = m["whole"], m["unit"] or ""
        plain, said_digits = whole.replace(",", ""), whole.translate({ord(str(k)): c for k, c in enumerate(SAID)})
        if m["part"]:
            said = f"{sino(int(plain))} 점 {m['part'].translate({ord(str(k)): c for k, c in enumerate(SAID)})}"
            return said + m["gap"] + ("퍼센트" if unit == "%" else unit)
        if unit == "%":
            return sino(int(plain)) + " 퍼센트"
        if unit.startswith("월") and 1 <= int(plain) <= 12:
            return {6: "유", 10: "시"}.get(int(plain), sino(int(plain))) + unit
        if unit.startswith(counters) and not unit.startswith("번호"):
            return f"{native(int(plain))} {unit}"
        if "," not in whole and (len(plain) >= 5 or (len(plain) > 1 and plain[0] == "0")) and not unit.startswith("원"):
            return f" {said_digits} {unit}"
        return sino(int(plain)) + (" " if unit and not unit.startswith("일") else "") + unit

    number = r"(?<!\d)(?P<hour>\d{1,2}):(?P<minute>\d{2})(?!\d)|(?<![\d.])(?P<whole>\d{1,3}(?:,\d{3})+|\d+)(?:\.(?P<part>\d+))?(?P<gap>\s*)(?P<unit>%|[가-힣]+)?"
    text = re.sub(number, one, text)
    return re.sub(r"\s+", " ", re.sub(r"\s+([.,?!~])", r"\1", re.sub(r"[^가-힣 .,?!~]", " ", text))).strip()


def said(text: Column) -> Column:
    return _per_text(say_numbers)(text)


def _sound(digit: str) -> int:
    return 0 if digit in NO_FINAL else 1 if digit in FINAL_R else 2


def agreeing(old: str, new: str, particle: str) -> str:
    """The particle behind ``old`` as it must be behind ``new``: it changes only where the kind of final sound does."""
    if not (old[-1:].isdigit() and new[-1:].isdigit()):
        return particle
    a, b = _sound(old[-1]), _sound(new[-1])
    if particle in ("으로", "로"):
        return particle if (a == 2) == (b == 2) else {"으로": "로", "로": "으로"}[particle]
    for whole, short in COPULA:  # the whole form is right behind any sound
        if particle in (whole, short):
            return whole if particle == short and not a and b else particle
    for final, open_ in PARTICLES:
        if particle in (final, open_) and bool(a) != bool(b):
            return open_ if particle == final else final
    return particle


def swap_values(text: str, pairs: list[tuple[str, str]]) -> tuple[str, int, int]:
    """Whole values replaced one pair after the other, the particle right behind made to agree: text, values and particles changed."""
    values = particles = 0
    for old, new in pairs:
        parts = re.split(rf"(?<![0-9A-Za-z\-])({re.escape(old)})(?![0-9A-Za-z\-])", text)
        for k in range(1, len(parts), 2):
            parts[k], values = new, values + 1
            if m := re.match(PARTICLE, parts[k + 1]):
                q = agreeing(old, new, m[0])
                parts[k + 1], particles = q + parts[k + 1][m.end() :], particles + (q != m[0])
        text = "".join(parts)
    return text, values, particles


def substitute(text: Column, old: Column, new: Column) -> Column:
    """struct(text, n, particles): ``swap_values`` of one pair."""

    def run(t: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [swap_values(x, [(y, z)]) if None not in (x, y, z) and y else (x, 0, 0) for x, y, z in zip(t, a, b, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n", "particles"])

    return F.pandas_udf(run, "text string, n int, particles int")(text, old, new)
