"""Guards that fail, driver-side settings, generation rules and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from utterloom.functions import records as R
from utterloom.functions import speech as P
from utterloom.functions import values as V
from utterloom.operators import dialogue as D
from utterloom.operators import facts as K
from utterloom.operators import generate as G
from utterloom.operators import guarded as J
from utterloom.operators import reports as Q
from utterloom.operators import scoring as S
from utterloom.sources import jsonl, settings
from utterloom.streaming import stats as T


def ids(spark, *xs):
    return spark.createDataFrame([(x, x * 10) for x in xs], "id long, v long")


@pytest.mark.parametrize(("join", "a", "b", "text"), [("lookup", (1, 2), (1,), "2"), ("lookup", (1,), (1, 1), "1"), ("one_to_one", (1, 2), (1,), "2"), ("one_to_one", (1,), (1, 2), "2"), ("one_to_one", (1, 1), (1,), "1")])
def test_joins_fail_on_keys_that_do_not_match(spark, join, a, b, text):
    with pytest.raises(Exception, match=f": {text}"):
        getattr(J, join)(ids(spark, *a), ids(spark, *b).withColumnRenamed("v", "w"), ["id"]).collect()


def test_joins_that_match(spark):
    right = ids(spark, 1, 2, 3).withColumnRenamed("v", "w")
    assert sorted(map(tuple, J.lookup(ids(spark, 1, 1, 2), right, ["id"]).select("id", "v", "w").collect())) == [(1, 10, 10), (1, 10, 10), (2, 20, 20)]
    assert J.one_to_one(ids(spark), right.limit(0), ["id"]).collect() == []
    runs = spark.createDataFrame([(1, "a", None), (2, "a", "x")], "id int, p string, q string").alias("a").join(spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, p string, q string").alias("b"), F.col("a.id") == F.col("b.id"))
    assert [r[0] for r in runs.orderBy("a.id").select(J.same_conditions("a", "b", ["p", "q"])).collect()] == [[], ["p", "q"]]


def test_heard_items_need_every_turn(spark):
    items = spark.createDataFrame([("i", [("a", "one"), ("b", "two")])], "item_id string, turns array<struct<speaker:string,text:string>>")
    index = spark.createDataFrame([("i", 0, "k0", False), ("i", 1, "k1", True)], "item_id string, turn long, key string, silent boolean")
    heard = spark.createDataFrame([("k0", "일이삼사")], "key string, heard string")
    (row,) = J.heard_items(items, index, heard, P.spoken_ids).collect()
    assert [tuple(t) for t in row["turns"]] == [("a", "1234"), ("b", "")] and row["written"] == ["one", "two"]
    with pytest.raises(Exception, match="turn not in the index"):
        J.heard_items(items, index.limit(1), heard).collect()
    with pytest.raises(Exception, match="nothing heard"):
        J.heard_items(items, index.withColumn("silent", F.lit(False)), heard).collect()


def test_settings():
    assert [settings.option(x) for x in ("a=1", "b = 0.5", "c=True", "d=x=y")] == [("a", 1), ("b", 0.5), ("c", True), ("d", "x=y")]
    assert [settings.duration(x) for x in (" -1", "30m", "1h30m", "1.5s")] == [-1, "30m", "1h30m", "1.5s"]
    assert settings.stratum("T=runs:x/1:40") == ("T", "runs:x/1", 40) and settings.group("g=a,b") == ("g", ["a", "b"]) and settings.named(["a=1", "b=c=d"]) == {"a": "1", "b": "c=d"}
    for f, bad in ((settings.option, "a"), (settings.option, "=1"), (settings.duration, "10 m"), (settings.duration, "1.5"), (settings.duration, ""), (settings.stratum, "a=b"), (settings.group, "a="), (settings.named, ["a=1", "a=2"])):
        with pytest.raises(ValueError):
            f(bad)
    assert [settings.fixed(x, 1) for x in (0.25, 0.35, -0.04, 2.0)] == ["0.2", "0.3", "0.0", "2.0"]


DOC = "# A\ntext\n```sh\n# B\n```\n## B\nb 12.5\n### C\nc\n## D\nd\n# E\n"


def test_sections():
    assert settings.section(DOC, "B") == ("b 12.5\n### C\nc", 1) and settings.section(DOC, "A")[0].startswith("text") and settings.section(DOC, "x") == (None, 0) and settings.section(DOC + "# B\n", "B") == (None, 2)
    assert settings.section(DOC, "E") == ("", 1) and settings.section(DOC, None) == (DOC.rstrip("\n"), 1)


def test_declared_numbers():
    good = {"where": "r.md", "section": "B", "context": "b 12.5", "kind": "point", "metric": "exact", "run": "r1", "value": 12.5}
    check = lambda d, v: settings.check_numbers([d], lambda _: DOC, lambda t: t.split()[1:], lambda _: v, ["exact"])
    assert check(good, [0.125]) == [] and check(good, [0.126])[0][1].startswith("computed") and check(good | {"context": "nothing 12.5"}, [0.125])[0][1] == "the context stands 0 times"
    for change in ({"kind": "x"}, {"metric": "y"}, {"base": "r0"}, {"value": [12.5]}, {"value": 12.55}, {"places": -1}, {"value": True}, {"run": ""}, {"more": 1}, {"kind": "paired"}, {"kind": "ci"}):
        assert settings.declaration_problems(good | change, ["exact"]), change
    assert settings.declaration_problems({k: v for k, v in good.items() if k != "run"}, ["exact"]) == ["missing run"]


def test_sources(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "manifest.json").write_text('{"model": "m",\n "shots": 3}')
    assert [tuple(r) for r in jsonl.read_manifests(spark, str(tmp_path), "model string, shots int").select("model", "shots", "run_id").collect()] == [("m", 3, "r1")]
    jsonl.write_report(spark.createDataFrame([(1, [("a", 2)])], "n int, t array<struct<k:string,v:int>>"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1, "t": [{"k": "a", "v": 2}]}
    (tmp_path / "x.log").write_text("old error\nnew line\nnew error\r\nend")
    assert [r["value"] for r in jsonl.matching_lines(spark, str(tmp_path / "x.log"), ["error", "end"], len("old error\n")).collect()] == ["new error", "end"]
    (tmp_path / "i.jsonl").write_text('{"item_id": "a", "turns": [{"speaker": "s", "text": "t"}], "meta": {"k": 1}}\n{"item_id": "b"}\n')
    items = jsonl.read_items(spark, str(tmp_path / "i.jsonl"))
    assert items.filter("item_id = 'a'").select("meta", "turns").first()["meta"].replace(" ", "") == '{"k":1}'
    with pytest.raises(Exception, match="item_id and turns"):
        items.collect()
    assert spark.range(1).select(F.lit(1).alias("b"), F.lit("x").alias("a")).select(jsonl.canonical_key(["b", "a"])).first()[0] == '{"a":"x","b":1}'
    with pytest.raises(ValueError, match="more than 2"):
        jsonl.markdown(spark.range(3).toDF("a"), 2)
    assert spark.range(1).select(R.json_value(F.lit('so {"a": "b"} end'), "a")).first()[0] == "b"


def test_spoken_forms():
    pairs = {"32,000원": "삼만 이천 원", "15%": "십오 퍼센트", "1.5배": "일 점 오배", "오후 2:30": "오후 두 시 삼십 분", "3개": "세 개", "21명": "스물한 명", "10월 6일": "시월 육일", "6월": "유월", "12345 번호": "일이삼사오 번호", "0": "영", "6291-7877-5168로": "육이구일, 칠팔칠칠, 오일육팔 로"}
    assert {k: P.say_numbers(k) for k in pairs} == pairs
    assert P.spell_ids("번호 없음") == "번호 없음"
    assert [P.agreeing("1", "2", "으로"), P.agreeing("3", "1", "으로"), P.agreeing("2", "3", "로"), P.agreeing("2", "1", "고"), P.agreeing("1", "2", "이고"), P.agreeing("1", "3", "을"), P.agreeing("1", "2", "이에요"), P.agreeing("a", "2", "을")] == ["으로", "로", "으로", "이고", "이고", "을", "예요", "을"]


@pytest.mark.parametrize(("a", "b", "n", "want"), [("x 6291 y", "x 6291 y", "6291", "6291"), ("x 6291 y", "x 162917 y", "6291", "162917"), ("x 6291 y", "x  y", "6291", ""), ("6291 6291", "6291 62", "6291", "6291"), ("x", "y", "1", None)])
def test_aligned_spans(a, b, n, want):
    assert G.aligned(a, b, n) == want
    assert G.aligned("6291 6291", "6291 62", "6291", 2) == "62"


def test_altered_dialogues(spark):
    turns = [("agent", "hi"), ("caller", "번호 1234567이에요"), ("agent", "1234567 맞죠"), ("caller", "네")]
    d = spark.createDataFrame([("a", turns, ["1234567"]), ("b", [("agent", "34567 and 1234567")], ["1234567"])], f"item_id string, turns {G.TURNS}, values array<string>")
    got = {r["item_id"]: r for r in G.swap_numbers(d, "s").collect()}
    assert got["a"]["ok"] and got["a"]["replaced"] == 2 and all("1234567" not in t["text"] for t in got["a"]["turns"])
    assert not got["b"]["ok"] and got["b"]["turns"][0]["text"] == "34567 and 1234567"  # the old digits also stand elsewhere
    new = got["a"]["new"][0]
    assert got["a"]["turns"][1]["text"] == f"번호 {new}{'예요' if new[-1] in '2459' else '이에요'}"
    n = G.insert_neutral(d, {"agent": [("wait", "ok")], "caller": [("hm", "yes")]}, "s")
    rows = {r["item_id"]: r for r in n.collect()}
    assert rows["b"]["at"] == -1 and rows["a"]["at"] in (2, 3) and rows["a"]["inserted"] == 2 and len(rows["a"]["turns"]) == 6
    rules = D.dialogue_problems(F.col("turns"), ["agent", "caller"], least=5)
    assert G.still_valid(n.filter("item_id = 'a'"), rules).count() == 1
    with pytest.raises(Exception, match="broke the dialogue rules"):
        G.still_valid(n, rules).collect()
    with pytest.raises(Exception, match="not an unaltered dev item: b"):
        G.for_variants(spark.createDataFrame([("a", "dev", False), ("b", "test", False)], "item_id string, split string, altered boolean")).collect()


def test_specs_are_reproducible():
    plan = {"outcomes": {"x": 1}, "slots": [("a", "d", "date", ""), ("b", "d", "date", "")], "extra": 0, "distractor": 0, "ordered": [("a", "b")], "facts": ["{a} {b}"]}
    rows = [G.make_spec(str(k), "s", plan, "1") for k in range(200)]
    assert rows == [G.make_spec(str(k), "s", plan, "1") for k in range(200)]
    assert all(G.month_day(r[3][0]["value"]) < G.month_day(r[3][1]["value"]) and r[8] == [f"{r[3][0]['value']} {r[3][1]['value']}"] for r in rows)
    with pytest.raises(ValueError, match="no distinct value"):
        G.make_spec("1", "s", plan | {"slots": [("a", "t", "text", "x"), ("b", "t", "text", "x")]}, "1")


def test_reviews_need_every_class(spark):
    targets = spark.createDataFrame([("a", ["f"], [])], "item_id string, serving array<string>, agreed array<string>")
    review = spark.createDataFrame([("a", {"f": "?"})], "item_id string, classes map<string,string>")
    with pytest.raises(Exception, match="no class for a f"):
        Q.review_tally(targets, review).collect()
    with pytest.raises(Exception, match="another data file"):
        Q.fingerprint_guard(spark.createDataFrame([("r", "x")], "run string, data_sha string"), "y").collect()


def test_failed_raters_and_lengths(spark):
    base = spark.createDataFrame([("a", ["포함", "누락"]), ("b", ["포함"])], "key string, verdicts array<string>")
    got = K.rated_facts(base, base.filter("key = 'a'")).orderBy("key", "pos").collect()
    assert [(r["key"], r["failed"], r["a"], r["b"]) for r in got] == [("a", False, False, False), ("a", False, True, True), ("b", True, False, False)]
    with pytest.raises(Exception, match="as many verdicts"):
        K.rated_facts(base, spark.createDataFrame([("b", ["포함", "누락"])], "key string, verdicts array<string>")).collect()
    with pytest.raises(Exception, match="templates"):
        spark.range(1).select(K.fact_slots(F.array(F.lit("{a} x")), F.array(F.lit("y x")), F.array(F.struct(F.lit("a").alias("slot"), F.lit("t").alias("type"), F.lit("z").alias("value"))))).collect()


def draws(seed, n_boot, k):
    import hashlib

    return [[int(hashlib.md5(f"{seed}:{r}:{p}".encode()).hexdigest()[:8], 16) % k for p in range(k)] for r in range(n_boot)]


def bounds(xs, alpha=0.05):
    v = sorted(x for x in xs if x is not None)
    return v[math.floor(alpha / 2 * (len(v) - 1))], v[math.floor((1 - alpha / 2) * (len(v) - 1))]


def plain_kappa(c):
    n = sum(c)
    pe = ((c[0] + c[1]) * (c[0] + c[2]) + (c[3] + c[2]) * (c[3] + c[1])) / n / n
    return None if pe >= 1 else ((c[0] + c[3]) / n - pe) / (1 - pe)


def test_resampled_intervals_equal_brute_force(spark):
    facts = [(i, bool((i + j) % 3), bool((i * j) % 4)) for i in range(12) for j in range(1 + i % 4)]
    other = [(i, a, bool((i + 2 * a) % 2)) for i, a, _ in facts]
    cells = [S.rating_cells(spark.createDataFrame(f, "item long, a boolean, b boolean"), "item", "a", "b") for f in (facts, other)]
    count = lambda f: [[sum(x == i and (a, b) == c for x, a, b in f) for c in ((True, True), (True, False), (False, True), (False, False))] for i in range(12)]
    one, two = count(facts), count(other)
    total = lambda rows, pick: [sum(rows[p][q] for p in pick) for q in range(4)]
    ks = [(plain_kappa(total(one, d)), plain_kappa(total(two, d))) for d in draws("3", 300, 12)]
    got = S.kappa_bootstrap(cells[0], "item", 300, "3").first()
    assert (got["low"], got["high"]) == pytest.approx(bounds(k[0] for k in ks))
    got = S.kappa_difference(cells[0], cells[1], "item", 300, "3").first()
    assert (got["diff"], got["low"], got["high"]) == pytest.approx((plain_kappa(total(one, range(12))) - plain_kappa(total(two, range(12))), *bounds(None if None in k else k[0] - k[1] for k in ks)))
    items = spark.createDataFrame([(i, i % 3, 1 + i % 4) for i in range(9)], "item long, n long, d long")
    got = S.ratio_bootstrap(items, "n", "d", "item", 200, "0").first()
    assert (got["low"], got["high"]) == pytest.approx(bounds(sum(p % 3 for p in d) / sum(1 + p % 4 for p in d) for d in draws("0", 200, 9)))
    a, b = (spark.createDataFrame([(i, i % k == 0) for i in range(20)], "item long, f boolean") for k in (4, 2))
    got = S.flag_difference(a, b, "f", "item", 200, "5").first()
    assert (got["diff"], got["low"], got["high"]) == pytest.approx((0.25, *bounds(sum((p % 2 == 0) - (p % 4 == 0) for p in d) / 20 for d in draws("5", 200, 20)))) and got["passed"] == (got["low"] > 0)


def test_requests_and_the_last_n_as_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 2}", float(i * 7 % 13), "shop" if i % 3 else "bank") for i in range(40)], "o long, k string, v double, domain string")
    for i in range(4):
        rows.filter(F.floor(F.col("o") / 10) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    problems = F.filter(F.array(F.when(F.col("domain") == "bank", "unknown domain")), lambda p: p.isNotNull())
    T.valid_requests(stream(), problems, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    good, bad = (spark.read.parquet(str(tmp_path / n)) for n in ("good", "bad"))
    assert good.count() == 26 and sorted(r["o"] for r in bad.collect()) == list(range(0, 40, 3)) and bad.first()["problems"] == ["unknown domain"]
    got: dict = {}

    def keep(batch, _):
        got.update({r["key"]: r for r in batch.collect()})

    T.stream_last_n(stream(), "k", "o", "v", 6).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    for k in ("k0", "k1"):
        v = sorted(r["v"] for r in rows.filter(F.col("k") == k).orderBy(F.desc("o")).limit(6).collect())
        assert (got[k]["n"], got[k]["p50"], got[k]["p95"]) == (6, v[3], v[4])
    e = spark.createDataFrame([("2026-01-01 10:00:00", "a"), ("2026-01-01 23:00:00", "a"), ("2026-01-02 01:00:00", "b")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    assert {(r["kind"], r["n"]) for r in T.windowed_counts(e, "ts", "kind").collect()} == {("a", 2), ("b", 1)}


def test_undefined_stays_undefined(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(Q.token_rate(F.lit(10), F.lit(0))) is None and one(Q.token_rate(F.lit(10), F.lit(2_000_000_000))) == 5.0
    assert one(V.fill_digits(F.lit("0-0"), F.lit("123"))) is None and one(V.one_digit_changed(F.lit("12"), F.lit("1x"))) is None and one(Q.worst(F.array().cast("array<string>"))) is None
    assert one(Q.discrete(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(4)), 0.5)) == 3 and one(Q.discrete(F.array().cast("array<int>"), 0.5)) is None
    r = spark.createDataFrame([(True, ["포함"], 1)], "ok boolean, verdicts array<string>, wrong int").withColumn("p", F.struct("ok", "verdicts", "wrong"))
    assert [tuple(x["j"]) for x in r.select(K.judged(F.lit(None).cast("string"), F.lit(2), F.col("p")).alias("j")).collect()] == [(["누락", "누락"], 0, True)]
    none = spark.createDataFrame([(None,)], "reply struct<prompt_tokens:int,completion_tokens:int,done_reason:string,latency_s:double,thinking:string>")
    assert tuple(none.select(*K.reply_fields(F.col("reply"))).first()) == (None, None, None, 0.0, 0)
    assert tuple(K.typed_scores(spark.createDataFrame([("a", ["포함"])], "item_id string, verdicts array<string>")).first())[2:] == (0, True)
