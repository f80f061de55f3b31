"""Input and expected pairs for the value and record functions."""

import pytest
from pyspark.sql import functions as F

from utterloom.functions import records as R
from utterloom.functions import speech as P
from utterloom.functions import values as V
from utterloom.operators import dialogue as D
from utterloom.operators import scoring as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("32000", 32000), ("32,000", 32000), ("3만 2천", 32000), ("삼만이천", 32000), ("1억 2,500만", 125_000_000), ("만", 10000), ("이천오백", 2500), ("12만3천400", 123400), ("abc", None), ("", None), ("일이삼", 3), ("0만", 10000), (None, None)],
)
def test_numbers(spark, text, want):
    assert one(spark, V.parse_number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("id", "6291-7877 5168", "629178775168"), ("id", "-", None), ("text", "은하 탭 9 Pro", "은하탭9pro"), ("amount", "월 6,200원", None), ("amount", " 3만2천 원", "32000"),
        ("date", "2026년 10월 5일", "10-05"), ("date", "10/5", "10-05"), ("date", "13월 5일", None), ("date", "6291-7877-5168", None), ("time", "오후 2시 30분", "14:30"), ("time", "저녁 7시 반", "19:30"),
        ("time", "낮 2시", "14:00"), ("time", "낮 11시", "11:00"), ("time", "25시 10:30", None), ("time", "9:05", "09:05"),
    ],
)
def test_normalize(spark, kind, value, want):
    assert one(spark, V.normalize(F.lit(kind), F.lit(value))) == want


def test_amounts_are_read_from_every_tail(spark):
    assert set(one(spark, V.amounts_in(F.lit("총 이 3만 2천 원 그리고 0원")))) == {"32000", "2000"} | set(one(spark, V.amounts_in(F.lit("이 3만 2천 원"))))


def test_occurs(spark):
    assert one(spark, V.occurs(F.lit("id"), F.lit("D1902657"), F.lit("OD 1902657 요")))
    assert not one(spark, V.occurs(F.lit("id"), F.lit("581696598958"), F.lit("5,816, 9,659에서 8,958")))
    assert one(spark, V.occurs(F.lit("id"), F.lit("581696598958"), F.lit("5,816, 9,659에서 8,958"), True))
    assert not one(spark, V.occurs(F.lit("amount"), F.lit("32,000원"), F.lit("132,000원")))
    assert not one(spark, V.occurs(F.lit("amount"), F.lit("none"), F.lit("1원")))


@pytest.mark.parametrize(("text", "want"), [('a {"x": "}"} b', '{"x": "}"}'), ("{ {}", "{}"), ('{"a\\"}": 1}', '{"a\\"}": 1}'), ("none", None), (None, None)])
def test_span(text, want):
    assert R.balanced_span(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("주문번호 디 일이삼사오육칠이에요", "주문번호 D1234567이에요"), ("이이팔칠 이 맞습니다", "2287 이 맞습니다"), ("이 15,900원", "이 15,900원"), ("통일 이후", "통일 이후"), ("알 공일이삼사오", "R012345"), (None, None),
    ],
)
def test_spoken_ids(text, want):
    assert P.digits_of_spoken_ids(text) == want


def test_spoken_ids_are_idempotent():
    for t in ("디 일이삼사오육칠 입니다", "육이구일, 칠팔칠칠, 오일육팔", "2287 3시"):
        once = P.digits_of_spoken_ids(t)
        assert P.digits_of_spoken_ids(once) == once


def test_shape(spark):
    shape = lambda n, g: one(spark, V.number_shape(F.lit(n).cast("string"), F.array(*map(F.lit, g)).cast("array<string>")))
    assert [shape(None, ["1"]), shape("1", []), shape("12", ["123"]), shape("125", ["123"]), shape("145", ["123"])] == ["unreadable", "no_gold_of_type", "other_length", "one_char 3>5", "same_length"]


def test_dialogue_problems(spark):
    turns = lambda rows: F.array(*(F.struct(F.lit(s).alias("speaker"), F.lit(t).alias("text")) for s, t in rows))
    rules = lambda rows: one(spark, D.dialogue_problems(turns(rows), ["a", "b"], least=2))
    assert rules([("a", "x"), ("b", "y")]) == []
    assert rules([("a", "x"), ("c", "y")]) == ["bad speaker or empty turn"]
    assert rules([("b", "x"), ("b", "漢"), ("b", "y"), ("b", "z")]) == ["does not start with the agent", "one speaker only", "3 consecutive same-speaker turns", "non-Korean script (Han/kana)"]
    assert one(spark, D.value_problems(F.lit("3만 2천 원이고 번호 D12345"), F.array(F.struct(F.lit("amount").alias("kind"), F.lit("금액").alias("type"), F.lit("3만 2천 원").alias("value"))))) == ["extra id 'D12345'"]


def test_metrics_on_nothing_are_undefined(spark):
    empty = spark.createDataFrame([], "tp int, fp int, fn int, exact int")
    assert list(S.evaluate(empty, ["entity_f1", "exact"]).first()) == [0, None, None]


def test_percentiles(spark):
    rows = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert list(S.discrete_percentiles(rows, "v", [("p50", 0.5), ("p95", 0.95)]).first()) == [4, 3, 3]


def test_kappa_is_undefined_when_chance_agrees(spark):
    rows = spark.createDataFrame([(True, True)] * 3, "a boolean, b boolean")
    assert S.kappa_table(rows, [], "a", "b").first()["kappa"] is None


def test_paired_runs_must_agree(spark):
    a, b = (spark.createDataFrame([(k, 1)], "id int, exact int") for k in (1, 2))
    with pytest.raises(Exception, match="different items"):
        S.paired_bootstrap(a, b, "exact", "id", 3).collect()


def test_registered_bootstraps_draw_2000_times(spark, tmp_path):
    import hashlib

    from utterloom.plans import queries as own

    rows = [(k * 3, k % 3 % 2) for k in range(25)]
    spark.createDataFrame(rows, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    altered = {r["doc_id"] for r in spark.createDataFrame(rows, "doc_id long, quality int").filter(f"{own.ALTERED} = 0").collect()}
    a = [q for _, q in rows]
    b = [1 - q if i in altered else q for i, q in rows]
    n = len(rows)
    draws = [[int(hashlib.md5(f"7:{rep}:{pos}".encode()).hexdigest()[:8], 16) % n for pos in range(n)] for rep in range(2000)]
    for name, f in (("q_bootstrap_ci_2000", lambda d: sum(a[k] for k in d) / n), ("q_paired_bootstrap_2000", lambda d: sum(b[k] for k in d) / n - sum(a[k] for k in d) / n)):
        v = sorted(map(f, draws))
        got = own.QUERIES[name](spark, str(tmp_path)).first()
        assert (got["draws"], got["low"], got["high"]) == (2000, pytest.approx(v[49]), pytest.approx(v[1949]))


def test_drawn_digits_are_those_of_md5():
    import hashlib

    from utterloom.operators import draws

    for prefix in (b"7:0:", b"7:1234:", b"s" * 40 + b":19:", b"s" * 60 + b":1:"):
        for low, high in ((0, 10), (10, 100), (12345, 12400), (9_999_990, 10_000_000)):
            assert draws.first_digits(prefix, low, high).tolist() == [int(hashlib.md5(prefix + str(p).encode()).hexdigest()[:8], 16) for p in range(low, high)]
    assert [high - low for low, high in draws.positions(1005)] == [10, 90, 900, 5]


def test_resampled_sums_skip_nulls(spark):
    import hashlib

    rows = [(k, None if k % 3 else k * 100_000, 1 - k % 2, None) for k in range(1100)]
    items = spark.createDataFrame(rows, "id long, v long, n int, e int").repartition(5)
    got = {r["rep"]: r for r in S.resampled(items, ["v", "n", "e"], "id", 90, "x").collect()}
    assert sorted(got) == list(range(90)) and S.resampled(items.limit(0), ["v"], "id", 90).collect() == []
    for rep in (0, 41, 89):
        d = [int(hashlib.md5(f"x:{rep}:{p}".encode()).hexdigest()[:8], 16) % 1100 for p in range(1100)]
        assert tuple(got[rep]) == (rep, sum(rows[p][1] or 0 for p in d), sum(rows[p][2] for p in d), None)


@pytest.mark.parametrize("name", ["q_bootstrap_ci_2000", "q_flag_difference", "q_kappa_boot", "q_kappa_difference", "q_value_recall_ci"])
def test_draws_are_no_rows(spark, name):
    """The plan makes no row for each draw."""
    from utterloom.plans import queries as own

    assert "sequence(0, 1999" not in own.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
