"""Typed values in text as Column expressions: normalise, extract, find. No Python runs on the executors.

Undefined is NULL everywhere. ``(?U)`` gives the regex classes their Unicode meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Korean digit names and units, day-part words and the patterns that values are read by.
DIGIT_NAMES = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
SMALL_UNITS = {"십": 10, "백": 100, "천": 1000}
BIG_UNITS = {"만": 10_000, "억": 100_000_000}
DATE_KO = r"(?U)(?:(\d{4})\s*[-./년]\s*)?(\d{1,2})\s*월\s*(\d{1,2})\s*일"
DATE_NUM = r"(?U)(?<![\d\-])(?:(\d{4})[-./])?(\d{1,2})[-./](\d{1,2})(?![\d\-])"
TIME_KO = r"(?U)(오전|오후|아침|저녁|밤|낮)?\s*(\d{1,2})\s*시(?:\s*(\d{1,2})\s*분|\s*(반))?"
TIME_COLON = r"(?U)(?<!\d)(\d{1,2}):(\d{2})(?!\d)"
AMOUNT_RUN = r"(?U)([\d,영공일이삼사오육칠팔구십백천만억 ]+?)\s*원"
DIGIT_RUN = r"(?U)\d+(?:\D{1,3}\d+)*"
FOREIGN_SCRIPT = "[぀-ヿ㐀-䶿一-鿿]"
VERIFY_WORDS = r"생년월일|주민등록|주민번호|본인 ?확인|뒷자리|뒤 ?[네4] ?자리"
ID_LIKE = r"(?<![\dA-Za-z\-])(?:[A-Z]\d{5,}|\d{2,5}(?:-\d{2,5}){1,3})(?![\dA-Za-z\-])"
BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  \t]"
CONTROLS = "[\u0000-\u001f\u007f-\u009f]"
KINDS = ("id", "amount", "date", "time", "text")


def norm_id(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, r"(?U)[\s\-_.·]", ""))


def norm_text(v: Column) -> Column:
    return F.lower(F.regexp_replace(v, r"(?U)\s+", ""))


def _lookup(token: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for name, value in table.items():
        out = F.when(token == name, F.lit(value).cast("long")).otherwise(out)
    return out


def parse_number(text: Column) -> Column:
    """Integer of mixed Korean and Arabic numerals; NULL if any other character is there or nothing is.

    Read left to right: small units multiply the last number into the section, big units the section into the total. Digit
    names in a row keep only the last; a unit without a number counts once.
    """
    null = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    tokens = F.regexp_extract_all(F.regexp_replace(text, r"(?U)[\s,]", ""), F.lit(r"([0-9]+|(?s:.))"), F.lit(1))

    def step(acc: Column, t: Column) -> Column:
        small, big = _lookup(t, SMALL_UNITS), _lookup(t, BIG_UNITS)
        digit = F.coalesce(_lookup(t, DIGIT_NAMES), F.expr("null").cast("long"))
        number = F.when(t.rlike("^[0-9]+$"), t.try_cast("long")).otherwise(digit)
        open_ = acc["section"] + F.coalesce(acc["num"], zero)
        whole = F.when(open_ == 0, F.lit(1).cast("long")).otherwise(open_)
        return F.struct(
            F.when(big.isNotNull(), acc["total"] + whole * big).otherwise(acc["total"]).alias("total"),
            F.when(big.isNotNull(), zero).when(small.isNotNull(), acc["section"] + F.coalesce(acc["num"], F.lit(1).cast("long")) * small).otherwise(acc["section"]).alias("section"),
            F.when(big.isNotNull() | small.isNotNull(), null).otherwise(number).alias("num"),
            (acc["ok"] & (big.isNotNull() | small.isNotNull() | number.isNotNull())).alias("ok"),
        )

    start = F.struct(zero.alias("total"), zero.alias("section"), null.alias("num"), F.lit(True).alias("ok"))
    end = lambda a: F.when(a["ok"], a["total"] + a["section"] + F.coalesce(a["num"], zero))
    read = F.when(F.size(tokens) > 0, F.aggregate(tokens, start, step, end))
    plain = F.regexp_replace(text, r"(?U)[\s,]", "")
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("long")).otherwise(read)  # most numbers have no unit


def norm_amount(v: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), r"(?U)\s*원$", "")
    return parse_number(bare).cast("string")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _group(v: Column, pattern: str, k: int) -> Column:
    """Group k of the first match; NULL if it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(v, pattern, k), F.lit(""))


def _month_day(v: Column, pattern: str) -> Column:
    month, day = _group(v, pattern, 2).cast("int"), _group(v, pattern, 3).cast("int")
    return F.when(month.between(1, 12) & day.between(1, 31), F.concat_ws("-", _two(month), _two(day)))


def norm_date(v: Column) -> Column:
    """MM-DD of the first readable pattern; the year is dropped."""
    return F.coalesce(_month_day(v, DATE_KO), _month_day(v, DATE_NUM))


def _clock(hour: Column, minute: Column) -> Column:
    return F.when(hour.between(0, 23) & minute.between(0, 59), F.concat_ws(":", _two(hour), _two(minute)))


def _time_ko(v: Column) -> Column:
    part, hour = F.regexp_extract(v, TIME_KO, 1), _group(v, TIME_KO, 2).cast("int")
    minute = F.coalesce(_group(v, TIME_KO, 3).cast("int"), F.when(F.regexp_extract(v, TIME_KO, 4) != "", 30).otherwise(0))
    late = (part.isin("오후", "저녁", "밤") & (hour < 12)) | ((part == "낮") & (hour < 6))
    return _clock(F.when(late, hour + 12).otherwise(hour), minute)


def _time_colon(v: Column) -> Column:
    return _clock(_group(v, TIME_COLON, 1).cast("int"), _group(v, TIME_COLON, 2).cast("int"))


def norm_time(v: Column) -> Column:
    """HH:MM. Where the Korean form stands, it alone decides, even if it is out of range."""
    return F.when(v.rlike(TIME_KO), _time_ko(v)).otherwise(_time_colon(v))


def _by_kind(kind: Column | str, branches: dict) -> Column:
    """The kind's branch: chosen while the plan is built if the kind is known, else a CASE. ``branches``: kind -> function without arguments."""
    if isinstance(kind, str):
        return branches[kind]()
    out = None
    for name, make in branches.items():
        out = F.when(kind == name, make()) if out is None else out.when(kind == name, make())
    return out


def normalize(kind: Column | str, v: Column) -> Column:
    return _by_kind(
        kind,
        {
            "id": lambda: F.nullif(norm_id(v), F.lit("")), "text": lambda: F.nullif(norm_text(v), F.lit("")), "amount": lambda: norm_amount(v),
            "date": lambda: norm_date(v), "time": lambda: norm_time(v),
        },
    )


def amounts_in(text: Column) -> Column:
    """All amounts before 원 as digit strings: every tail of a run's words that reads as a number above 0."""
    runs = F.regexp_extract_all(text, F.lit(AMOUNT_RUN), F.lit(1))

    def tails(run: Column) -> Column:
        words = F.filter(F.split(run, " "), lambda w: w != "")
        return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, k, F.size(words)), ""))).otherwise(F.array().cast("array<string>"))

    numbers = F.transform(F.flatten(F.transform(runs, tails)), parse_number)
    return F.array_distinct(F.transform(F.filter(numbers, lambda n: n > 0), lambda n: n.cast("string")))


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def dates_in(text: Column) -> Column:
    both = F.concat(F.transform(_hits(text, DATE_KO), lambda h: _month_day(h, DATE_KO)), F.transform(_hits(text, DATE_NUM), lambda h: _month_day(h, DATE_NUM)))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def times_in(text: Column) -> Column:
    both = F.concat(F.transform(_hits(text, TIME_KO), _time_ko), F.transform(_hits(text, TIME_COLON), _time_colon))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull()))


def values_in(kind: Column | str, text: Column) -> Column:
    return _by_kind(kind, {"amount": lambda: amounts_in(text), "date": lambda: dates_in(text), "time": lambda: times_in(text)})


def digit_runs(text: Column) -> Column:
    """Digits of numbers that at most three other characters part."""
    return F.transform(_hits(text, DIGIT_RUN), lambda r: F.regexp_replace(r, r"(?U)\D", ""))


def occurs(kind: Column | str, value: Column, text: Column, spoken: Column | bool = False) -> Column:
    """Whether the value can be found in the text. Unreadable values are not found.

    ``spoken`` also accepts an id whose digits (four at least) stand inside one digit run.
    """
    norm = normalize(kind, value)

    def as_id() -> Column:
        written = norm_id(text).contains(norm)
        if spoken is False:
            return written
        digits = F.regexp_replace(norm, r"(?U)\D", "")
        inside = (F.length(digits) >= 4) & F.exists(digit_runs(text), lambda r: r.contains(digits))
        return written | ((F.lit(True) if spoken is True else spoken) & inside)

    listed = {k: lambda k=k: F.array_contains(values_in(k, text), norm) for k in ("amount", "date", "time")}
    return F.coalesce(_by_kind(kind, {"id": as_id, "text": lambda: norm_text(text).contains(norm)} | listed), F.lit(False))


def text_index(text: Column) -> Column:
    """What a text holds, read once for any number of values: struct(ids, words, runs, amounts, dates, times)."""
    return F.struct(
        norm_id(text).alias("ids"), norm_text(text).alias("words"), digit_runs(text).alias("runs"), amounts_in(text).alias("amounts"),
        dates_in(text).alias("dates"), times_in(text).alias("times"),
    )


def found_at(kind: Column, value: Column, index: Column, spoken: Column | bool = False) -> Column:
    """``occurs`` over a ``text_index``."""
    norm = normalize(kind, value)
    digits = F.regexp_replace(norm, r"(?U)\D", "")
    inside = (F.length(digits) >= 4) & F.exists(index["runs"], lambda r: r.contains(digits))
    said = F.lit(spoken) if isinstance(spoken, bool) else spoken
    out = F.when(kind == "id", index["ids"].contains(norm) | (said & inside)).when(kind == "text", index["words"].contains(norm))
    for k in ("amount", "date", "time"):
        out = out.when(kind == k, F.array_contains(index[k + "s"], norm))
    return F.coalesce(out, F.lit(False))


# Words that stand where a value is missing, and marks of a speaker.
PLACEHOLDERS = ("없음", "해당없음", "알수없음", "모름", "미상", "불명", "미정", "미확인", "미확정", "미제공", "미입력", "미지정", "미언급", "null", "none", "n/a", "-")
SPEAKER_MARK = r"(?U)(?:상담원|고객)\s*[:：]"
MOST_CHARS, MOST_TURNS, MOST_TURN_CHARS, MOST_BODY = 4_000, 200, 2_000, 1 << 20


def is_placeholder(value: Column) -> Column:
    return norm_text(value).isin(*PLACEHOLDERS)


def has_speaker_mark(text: Column) -> Column:
    return text.rlike(SPEAKER_MARK)


def verification_words(text: Column) -> Column:
    return text.rlike(VERIFY_WORDS)


def has_hangul(text: Column) -> Column:
    return text.rlike("[가-힣]")


def spoken_digit_runs(text: Column) -> Column:
    """How many runs of four digit names or more a text has."""
    return F.regexp_count(text, F.lit("[공영일이삼사오육칠팔구]{4,}"))


def number_tokens(text: Column) -> Column:
    """Numbers of a prose text as plain text: minus as "-", no plus, no thousands separators, no sign of a zero.

    Digits joined to Latin letters, underscores or full stops belong to names and versions.
    """
    pattern = r"(?<![0-9A-Za-z_.])([+\-−]?)(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![0-9A-Za-z]|\.\d)"

    def plain(hit: Column) -> Column:
        digits = F.regexp_replace(hit, "[^0-9.]", "")
        return F.when(hit.rlike("^[-−]") & digits.rlike("[1-9]"), F.concat(F.lit("-"), digits)).otherwise(digits)

    return F.transform(_hits(text, pattern), plain)


def fill_digits(template: Column, digits: Column) -> Column:
    """The template with its digits replaced by ``digits`` one after the other; NULL if their number differs."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        hole = c.rlike("[0-9]")
        return F.struct(F.concat(acc["text"], F.when(hole, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("text"), (acc["at"] + hole.cast("int")).alias("at"))

    holes = F.length(F.regexp_replace(template, "[^0-9]", ""))
    return F.when(holes == F.length(digits), F.aggregate(F.split(template, ""), start, step, lambda a: a["text"]))


def one_digit_changed(right: Column, wrong: Column) -> Column:
    """Place (from 0) of the only character that differs, if it is a digit on both sides; else NULL."""
    pairs = F.transform(F.arrays_zip(F.split(right, "").alias("a"), F.split(wrong, "").alias("b")), lambda p, i: F.struct(p["a"].alias("a"), p["b"].alias("b"), i.alias("i")))
    odd = F.filter(pairs, lambda p: p["a"] != p["b"])
    one = F.get(odd, F.lit(0))
    return F.when((F.length(right) == F.length(wrong)) & (F.size(odd) == 1) & one["a"].rlike("[0-9]") & one["b"].rlike("[0-9]"), one["i"])


def digit_windows(value: Column, size: int = 4) -> Column:
    """All runs of ``size`` digits of a value's digits, which are one if there are fewer."""
    d = F.regexp_replace(value, "[^0-9]", "")
    many = F.transform(F.sequence(F.lit(1), F.length(d) - size + 1), lambda k: F.substring(d, k, F.lit(size)))
    return F.when(F.length(d) == 0, F.array().cast("array<string>")).when(F.length(d) <= size, F.array(d)).otherwise(F.array_distinct(many))


def touches(value: Column, text: Column, size: int = 4) -> Column:
    """Whether some ``size`` digits of the value stand in a digit run (joined by single blanks or hyphens) of the text."""
    runs = F.transform(_hits(text, r"\d+(?:[ \-]\d+)*"), lambda r: F.regexp_replace(r, r"\D", ""))
    return F.exists(digit_windows(value, size), lambda w: F.exists(runs, lambda r: r.contains(w)))


def dates_in_order(first: Column, later: Column) -> tuple[Column, Column]:
    """The two values, swapped if the first is the later date; an unreadable date is the earliest."""
    a, b = (F.coalesce(norm_date(c), F.lit("")) for c in (first, later))
    return F.when(a > b, later).otherwise(first), F.when(a > b, first).otherwise(later)


def written_form_ok(label: Column, value: Column, formats: dict[str, str]) -> Column:
    """Whether a value as written (trimmed) has its label's form; labels without one are right."""
    out = F.lit(True)
    for name, pattern in formats.items():
        out = F.when(label == name, F.trim(value).rlike(f"^(?:{pattern})$")).otherwise(out)
    return out


def request_problems(turns: Column, domain: Column, domains: Column) -> Column:
    """What makes a request unfit: its domain, its number of turns, their length and characters, the whole transcript's length."""
    names = F.array(F.lit("상담원"), F.lit("고객"))
    chars = F.aggregate(turns, F.lit(0), lambda n, t: n + F.length(t["speaker"]) + 2 + F.length(t["text"])) + F.size(turns) - 1
    return F.filter(
        F.array(
            F.when(~F.array_contains(domains, domain), "unknown domain"), F.when(~F.size(turns).between(1, MOST_TURNS), "number of turns"),
            F.when(F.exists(turns, lambda t: ~F.array_contains(names, t["speaker"])), "speaker"), F.when(F.exists(turns, lambda t: F.length(t["text"]) > MOST_TURN_CHARS), "turn too long"),
            F.when(F.exists(turns, lambda t: one_line(t["text"]).rlike(CONTROLS)), "control characters"), F.when(chars > MOST_CHARS, "transcript too long"),
        ),
        lambda p: p.isNotNull(),
    )


def windows_of_digits(text: Column, size: int = 4) -> Column:
    """All windows of ``size`` digits of runs that single blanks or hyphens join."""
    runs = F.transform(_hits(text, r"\d+(?:[ \-]\d+)*"), lambda r: F.regexp_replace(r, r"\D", ""))
    long = F.filter(runs, lambda r: F.length(r) >= size)
    return F.array_distinct(F.flatten(F.transform(long, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - size + 1), lambda k: F.substring(r, k, F.lit(size))))))


def one_line(text: Column) -> Column:
    """Line breaks and tabs of any kind as one blank each."""
    return F.regexp_replace(text, BREAKS, " ")


def has_controls(text: Column) -> Column:
    return text.rlike(CONTROLS)


def foreign_script(text: Column) -> Column:
    return text.rlike(FOREIGN_SCRIPT)


def id_like(text: Column) -> Column:
    return _hits(text, ID_LIKE)


def sentence_count(text: Column) -> Column:
    return F.regexp_count(F.concat(text, F.lit(" ")), F.lit("[.!?。]|[다함음됨] "))


def hamming(a: Column, b: Column) -> Column:
    return F.when(F.length(a) == F.length(b), F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x))


def number_shape(norm: Column, golds: Column) -> Column:
    """How a wrong number differs from the nearest gold number of the same length; golds are an array.

    One of unreadable, no_gold_of_type, other_length, one_char g>p, same_length.
    """
    same = F.filter(F.array_sort(F.array_distinct(golds)), lambda g: F.length(g) == F.length(norm))
    near = F.array_min(F.transform(same, lambda g, i: F.struct(hamming(norm, g).alias("d"), i.alias("i"), g.alias("g"))))
    odd = F.filter(F.zip_with(F.split(near["g"], ""), F.split(norm, ""), lambda g, p: F.when(g != p, F.concat(g, F.lit(">"), p))), lambda x: x.isNotNull())
    return (
        F.when(norm.isNull(), "unreadable").when(F.size(golds) == 0, "no_gold_of_type").when(F.size(same) == 0, "other_length")
        .when(near["d"] == 1, F.concat(F.lit("one_char "), F.element_at(odd, 1))).otherwise("same_length")
    )
