"""The registered queries of the engine's own operators, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import speech as P
from ..functions import values as V
from ..operators import choosing as C
from ..operators import dialogue as D
from ..operators import scoring as S
from ..streaming import stats as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


UTTERANCE = (
    "concat('주문번호 D', lpad(cast(o_orderkey AS STRING), 7, '0'), ' 금액 ', cast(cast(floor(o_totalprice) AS BIGINT) AS STRING), '원 ', "
    "cast(month(o_orderdate) AS STRING), '월 ', cast(day(o_orderdate) AS STRING), '일 오후 ', cast(o_orderkey % 12 AS STRING), '시')"
)
HASH = "md5(cast({} AS STRING))"
DIGIT = "(ascii(substr(md5(cast({} AS STRING)), {}, 1)) % {})"
PART_MD = "concat(lpad(cast(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(cast(day(o_orderdate) AS STRING), 2, '0'))"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("text", F.expr(UTTERANCE))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.transcripts(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


# --- transcripts and quality rules

TRANSCRIPT = """SELECT conv_id, count(*) AS n, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS transcript,
  sum(CASE WHEN role = before THEN 1 ELSE 0 END) AS pairs, arg_min(role, turn) AS first_role, count(DISTINCT role) AS roles,
  max(CASE WHEN regexp_matches(coalesce(text, ''), '[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]') THEN 1 ELSE 0 END) AS script,
  max(CASE WHEN role NOT IN ('user', 'assistant', 'system') OR trim(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) = '' THEN 1 ELSE 0 END) AS bad
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) t GROUP BY conv_id"""
PROBLEMS = f"""SELECT conv_id, unnest(list_filter(CASE WHEN bad = 1 THEN [c, 'bad speaker or empty turn'] ELSE [c,
    CASE WHEN first_role <> 'user' THEN 'does not start with the agent' END,
    CASE WHEN roles < 3 THEN 'one speaker only' END,
    CASE WHEN pairs > 2 THEN cast(pairs AS STRING) || ' consecutive same-speaker turns' END,
    CASE WHEN script = 1 THEN 'non-Korean script (Han/kana)' END] END, lambda x: x IS NOT NULL)) AS problem
  FROM (SELECT *, CASE WHEN n NOT BETWEEN 4 AND 40 THEN 'turn count ' || cast(n AS STRING) END AS c FROM ({TRANSCRIPT}) a) b"""


@query(f"SELECT conv_id, n AS n_turns, transcript, CAST(pairs AS BIGINT) AS same_speaker_pairs, first_role FROM ({TRANSCRIPT}) t")
def q_transcript_assemble(spark, sf_dir):
    t = conversations(spark, sf_dir)
    return t.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "transcript", D.same_in_row(F.col("turns")).cast("long").alias("same_speaker_pairs"), F.get("turns", F.lit(0))["speaker"].alias("first_role"))


def _problems(spark, sf_dir):
    return conversations(spark, sf_dir).withColumn("problems", D.dialogue_problems(F.col("turns"), ["user", "assistant", "system"], least=4))


@query(PROBLEMS)
def q_dialogue_problems(spark, sf_dir):
    return _problems(spark, sf_dir).select("conv_id", F.explode("problems").alias("problem"))


@query(f"SELECT regexp_replace(regexp_replace(regexp_replace(problem, ' *([[(]).*$', ''), '^[0-9]+ ', ''), ' [0-9]+$', '') AS reason, count(*) AS n FROM ({PROBLEMS}) p GROUP BY 1")
def q_problem_reasons(spark, sf_dir):
    return D.rejection_report(_problems(spark, sf_dir), "problems")


# --- values in text


@query("""SELECT o_orderkey, upper(regexp_replace('d-' || cast(o_orderkey AS STRING) || '_x. ' || o_orderpriority, '[ _.-]', '', 'g')) AS id_norm,
  lower(replace(o_orderpriority, ' ', '')) AS text_norm FROM orders""")
def q_text_normalize(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", V.norm_id(F.concat(F.lit("d-"), F.col("o_orderkey").cast("string"), F.lit("_x. "), "o_orderpriority")).alias("id_norm"), V.norm_text(F.col("o_orderpriority")).alias("text_norm"))


@query("""SELECT o_orderkey, cast(cast(floor(o_totalprice) AS BIGINT) AS STRING) AS arabic,
  cast(cast(floor(o_totalprice) AS BIGINT) AS STRING) AS mixed, CASE WHEN cast(floor(o_totalprice) AS BIGINT) // 10000 % 10 = 0 THEN '10000' ELSE cast(cast(floor(o_totalprice) AS BIGINT) // 10000 % 10 * 10000 AS STRING) END AS spoken FROM orders""")
def q_amount_parse(spark, sf_dir):
    n = F.floor("o_totalprice")
    high, low = (n / 10000).cast("long"), n % 10000
    mixed = F.when(high > 0, F.concat(high.cast("string"), F.lit("만 "), low.cast("string"))).otherwise(low.cast("string"))
    names = F.array(*map(F.lit, ["영", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]))
    o = read(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", V.norm_amount(F.concat(F.lit(" "), F.format_number(n, 0), F.lit("원 "))).alias("arabic"), V.norm_amount(F.concat(mixed, F.lit(" 원"))).alias("mixed"),
        V.norm_amount(F.concat(F.get(names, (high % 10).cast("int")), F.lit("만"))).alias("spoken"),
    )


@query(f"SELECT o_orderkey, {PART_MD} AS ko, {PART_MD} AS numeric FROM orders")
def q_date_parse(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", V.norm_date(F.concat(F.lit("접수는 "), F.date_format("o_orderdate", "yyyy년 M월 d"), F.lit("일"))).alias("ko"), V.norm_date(F.date_format("o_orderdate", "yyyy/M/d")).alias("numeric"))


@query("""SELECT event_id, strftime(ts, '%H:%M') AS colon, lpad(cast(hour(ts) % 12 + 12 AS STRING), 2, '0') || ':' || lpad(cast(minute(ts) AS STRING), 2, '0') AS afternoon,
  lpad(cast(hour(ts) AS STRING), 2, '0') || ':30' AS half FROM events""")
def q_time_parse(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    part = F.concat(F.lit("오후 "), (F.hour("ts") % 12).cast("string"), F.lit("시 "), F.minute("ts").cast("string"), F.lit("분"))
    return e.select("event_id", V.norm_time(F.date_format("ts", "H:mm")).alias("colon"), V.norm_time(part).alias("afternoon"), V.norm_time(F.concat(F.hour("ts").cast("string"), F.lit("시 반"))).alias("half"))


@query(f"""SELECT o_orderkey, [cast(cast(floor(o_totalprice) AS BIGINT) AS STRING)] AS amounts, [{PART_MD}] AS dates,
  [lpad(cast(o_orderkey % 12 + 12 AS STRING), 2, '0') || ':00'] AS times FROM orders""")
def q_values_in_text(spark, sf_dir):
    u = utterances(spark, sf_dir)
    return u.select("o_orderkey", V.amounts_in(F.col("text")).alias("amounts"), V.dates_in(F.col("text")).alias("dates"), V.times_in(F.col("text")).alias("times"))


@query("""SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+(?:[^0-9]{1,3}[0-9]+)*'), lambda r: regexp_replace(r, '[^0-9]', '', 'g')) AS runs
  FROM documents WHERE regexp_matches(text, '[0-9]')""")
def q_digit_runs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]"))
    return d.select("doc_id", V.digit_runs(F.col("text")).alias("runs"))


@query(f"""SELECT o_orderkey, true AS id_found, {DIGIT.format('o_orderkey', 1, 3)} <> 0 AS amount_found, true AS date_found,
  o_orderkey % 7 = 0 AS wrong_found FROM orders""")
def q_value_occurs(spark, sf_dir):
    u = utterances(spark, sf_dir)
    amount = F.floor("o_totalprice") + F.when(F.expr(DIGIT.format("o_orderkey", 1, 3)) == 0, 1).otherwise(0)
    wrong = F.when(F.col("o_orderkey") % 7 == 0, F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).otherwise(F.lit("X99999999"))
    found = lambda kind, v: V.occurs(kind, v, F.col("text"))
    return u.select(
        "o_orderkey", found("id", F.concat(F.lit("d"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))).alias("id_found"), found("amount", F.concat(amount.cast("string"), F.lit("원"))).alias("amount_found"),
        found("date", F.date_format("o_orderdate", "M/d")).alias("date_found"), found("id", wrong).alias("wrong_found"),
    )


@query(f"""SELECT o_orderkey, CASE WHEN {DIGIT.format('o_orderkey', 1, 4)} = 0 THEN ['format'] WHEN {DIGIT.format('o_orderkey', 1, 4)} = 1 THEN ['not in transcript'] ELSE []::VARCHAR[] END AS reasons FROM orders""")
def q_identifier_flags(spark, sf_dir):
    u = utterances(spark, sf_dir).withColumn("m", F.expr(DIGIT.format("o_orderkey", 1, 4)))
    key = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    value = F.when(F.col("m") == 0, F.concat(F.lit("Q"), key)).when(F.col("m") == 1, F.concat(F.lit("D9"), F.substring(key, 2, 6))).otherwise(F.concat(F.lit("D"), key))
    formats = spark.createDataFrame([("주문번호", r"D\d{7}")], "type string, id_format string")
    u = u.withColumn("value", value).withColumn("type", F.lit("주문번호")).join(F.broadcast(formats), "type", "left")
    return u.select("o_orderkey", D.identifier_flags(F.lit(True), V.norm_id(F.col("value")), F.col("id_format"), V.occurs("id", F.col("value"), F.col("text"), True)).alias("reasons"))


@query(f"""SELECT shape, count(*) AS n FROM (SELECT CASE {DIGIT.format('o_orderkey', 2, 4)} WHEN 0 THEN 'unreadable' WHEN 1 THEN 'other_length'
  WHEN 2 THEN 'one_char ' || right(cast(o_orderkey AS STRING), 1) || '>X' ELSE 'no_gold_of_type' END AS shape FROM orders) s GROUP BY 1""")
def q_number_shape(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("gold"), F.expr(DIGIT.format("o_orderkey", 2, 4)).alias("m"))
    norm = F.when(F.col("m") == 0, F.lit(None)).when(F.col("m") == 1, F.concat("gold", F.lit("0"))).otherwise(F.concat(F.expr("left(gold, length(gold) - 1)"), F.lit("X")))
    golds = F.when(F.col("m") == 3, F.array().cast("array<string>")).otherwise(F.array("gold"))
    return o.groupBy(V.number_shape(norm, golds).alias("shape")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT page_id, length(regexp_replace(html, '\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\t\x{85}\x{2028}\x{2029}]', ' ', 'g')) AS n, regexp_matches(html, '[\x{0}-\x{1f}\x{7f}-\x{9f}]') AS controls,
  regexp_matches(html, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]') AS foreign_script FROM pages"""
)
def q_control_chars(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.length(V.one_line(F.col("html"))).cast("long").alias("n"), V.has_controls(F.col("html")).alias("controls"), V.foreign_script(F.col("html")).alias("foreign_script"))


@query(r"SELECT doc_id, len(regexp_extract_all(text || ' ', '[.!?。]|[다함음됨] ')) AS sentences, length(text) BETWEEN 40 AND 600 AS fits FROM documents")
def q_sentence_count(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", V.sentence_count(F.col("text")).cast("long").alias("sentences"), F.length("text").between(40, 600).alias("fits"))


# --- replies


@query("""SELECT o_orderkey, o_orderkey % 5 <> 2 AS json_ok, o_orderkey % 5 IN (0, 1) AS schema_ok, CASE o_orderkey % 5 WHEN 2 THEN 'no JSON object' WHEN 3 THEN 'schema' WHEN 4 THEN 'schema' END AS error,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_orderstatus END AS category FROM orders""")
def q_parse_reply(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    good = F.concat(F.lit('{"category":"'), "o_orderstatus", F.lit('","resolution":"해결","entities":[{"type":"t","value":"}{"}],"follow_up":{"required":false,"codes":[]},"summary":"s \\" {"}'))
    m = F.col("o_orderkey") % 5
    text = (
        F.when(m == 0, F.concat(F.lit("ok "), good, F.lit(" end"))).when(m == 1, good).when(m == 2, F.lit("no json } {"))
        .when(m == 3, F.regexp_replace(good, '"summary"', '"confidence":1,"summary"')).otherwise(F.concat(F.lit("x { y "), F.regexp_replace(good, "해결", "모름")))
    )
    r = o.withColumn("r", R.parse_record(R.json_span(text)))
    return r.select("o_orderkey", "r.json_ok", "r.schema_ok", "r.error", F.col("r.record.category").alias("category"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS ok, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS INTEGER) ELSE 0 END AS wrong FROM orders""")
def q_parse_verdicts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    second = F.when(F.col("o_orderkey") % 3 == 1, "other").otherwise("누락")
    text = F.concat(F.lit('so: {"verdicts":["포함","'), second, F.lit('"],"wrong":'), F.when(F.col("o_orderkey") % 3 == 2, F.lit("-1")).otherwise((F.col("o_orderkey") % 4).cast("string")), F.lit("}"))
    r = o.withColumn("r", R.parse_verdicts(text, F.lit(2), ("포함", "누락", "오류")))
    return r.select("o_orderkey", "r.ok", "r.wrong")


# --- scoring

PRED_SQL = f"SELECT l_orderkey, CASE WHEN m = 1 THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_linestatus FROM (SELECT *, {DIGIT.format('l_orderkey * 10 + l_linenumber', 3, 5)} AS m FROM lineitem) x, (VALUES (1), (2)) AS v(k) WHERE m <> 0 AND (k = 1 OR m = 2)"
SCORE_SQL = f"""SELECT l_orderkey, CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS fp, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS fn FROM (
  SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM
  (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS g FROM lineitem GROUP BY ALL) a FULL JOIN
  (SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS p FROM ({PRED_SQL}) q GROUP BY ALL) b
  ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus) c GROUP BY 1"""


def predictions(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").withColumn("m", F.expr(DIGIT.format("l_orderkey * 10 + l_linenumber", 3, 5))).filter("m <> 0")
    x = x.withColumn("copy", F.explode(F.when(F.col("m") == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return x.select("l_orderkey", F.when(F.col("m") == 1, "Z").otherwise(F.col("l_returnflag")).alias("l_returnflag"), "l_linestatus")


def item_scores(spark, sf_dir):
    return S.multiset_match(read(spark, sf_dir, "lineitem"), predictions(spark, sf_dir), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query(SCORE_SQL)
def q_multiset_score(spark, sf_dir):
    return item_scores(spark, sf_dir)


METRIC_SQL = "count(*) AS n, sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE AS entity_p, sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE AS entity_r, 2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::DOUBLE AS entity_f1, sum(CASE WHEN fp + fn = 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS exact"


@query(f"SELECT {METRIC_SQL} FROM ({SCORE_SQL}) s")
def q_metric_summary(spark, sf_dir):
    return S.evaluate(item_scores(spark, sf_dir).withColumn("exact", (F.col("fp") + F.col("fn") == 0).cast("int")), ["entity_p", "entity_r", "entity_f1", "exact"])


@query(f"SELECT o_orderpriority, {METRIC_SQL} FROM ({SCORE_SQL}) s JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def q_metric_by_group(spark, sf_dir):
    s = item_scores(spark, sf_dir).withColumn("exact", (F.col("fp") + F.col("fn") == 0).cast("int"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return S.evaluate(s.join(o, s["l_orderkey"] == o["o_orderkey"]), ["entity_p", "entity_r", "entity_f1", "exact"], ["o_orderpriority"])


MACRO_ROWS = f"SELECT user_id % 5 AS bucket, event_type AS gold, CASE WHEN {DIGIT.format('event_id', 4, 6)} = 0 THEN 'view' ELSE event_type END AS pred FROM events"


@query(f"""WITH r AS ({MACRO_ROWS}), g AS (SELECT bucket, gold AS label, count(*) AS n, sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS tp FROM r GROUP BY ALL),
  p AS (SELECT bucket, pred AS label, count(*) AS n FROM r GROUP BY ALL)
  SELECT g.bucket, round(avg(2 * tp / (g.n + coalesce(p.n, 0))::DOUBLE), 9) AS macro_f1 FROM g LEFT JOIN p ON g.bucket = p.bucket AND g.label = p.label GROUP BY 1""")
def q_macro_f1(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("bucket"), F.col("event_type").alias("gold"), F.when(F.expr(DIGIT.format("event_id", 4, 6)) == 0, "view").otherwise(F.col("event_type")).alias("pred"))
    return S.macro_f1(e, ["bucket"], "gold", "pred").select("bucket", F.round("macro_f1", 9).alias("macro_f1"))


@query("""SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS long_ones, count(DISTINCT user_id) AS users, sum(CASE WHEN props IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_props FROM events GROUP BY 1""")
def q_run_checks(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("long_ones"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("props").isNull()).alias("no_props"))


PCTL = "SELECT {k}, max(n) AS n, max(CASE WHEN r = n // 2 THEN v END) AS p50, max(CASE WHEN r = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN v END) AS p95 FROM (SELECT {k}, {v} AS v, row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS r, count(*) OVER (PARTITION BY {k}) AS n FROM {t} WHERE {v} IS NOT NULL) x GROUP BY 1"


@query(PCTL.format(k="event_type", v="value", t="events"))
def q_percentile_discrete(spark, sf_dir):
    return S.discrete_percentiles(read(spark, sf_dir, "events"), "value", [("p50", 0.5), ("p95", 0.95)], ["event_type"])


@query(PCTL.format(k="l_returnflag", v="l_quantity", t="lineitem"))
def q_latency_by_class(spark, sf_dir):
    return S.discrete_percentiles(read(spark, sf_dir, "lineitem"), "l_quantity", [("p50", 0.5), ("p95", 0.95)], ["l_returnflag"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
  SELECT user_id, max(CASE WHEN k = 1 THEN value END) AS first_value, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS warm, min(CASE WHEN k > 1 THEN value END) AS low, max(CASE WHEN k > 1 THEN value END) AS high FROM r GROUP BY 1""")
def q_bench_summary(spark, sf_dir):
    r = read(spark, sf_dir, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    warm = lambda f: f(F.when(F.col("k") > 1, F.col("value")))
    return r.groupBy("user_id").agg(F.max(F.when(F.col("k") == 1, F.col("value"))).alias("first_value"), F.count_if(F.col("k") > 1).alias("warm"), warm(F.min).alias("low"), warm(F.max).alias("high"))


@query("""SELECT event_type, count(*) AS n, round(count(*) / nullif(epoch(max(ts)) - epoch(min(ts)), 0), 9) AS per_second FROM events GROUP BY 1""")
def q_load_summary(spark, sf_dir):
    wall = F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.try_divide(F.count("*").cast("double"), wall), 9).alias("per_second"))


@query("""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k <= 20""")
def q_rolling_last_n(spark, sf_dir):
    return T.last_n(read(spark, sf_dir, "events"), ["ts", "event_id"], 20, ["event_type"]).select("event_type", "event_id", "value")


@query("SELECT o.outcome, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('never')) AS o(outcome) LEFT JOIN events e ON e.event_type = o.outcome GROUP BY 1")
def q_outcome_counts(spark, sf_dir):
    return T.outcome_counts(read(spark, sf_dir, "events"), "event_type", ["click", "view", "never"])


BOOT = """draws AS (SELECT rep, ('0x' || substr(md5('7:' || cast(rep AS STRING) || ':' || cast(pos AS STRING)), 1, 8))::BIGINT % k AS pos FROM numbered, (SELECT count(*) AS k FROM numbered) n, range(40) r(rep))"""
INTERVAL = """SELECT count(*) AS draws, max(CASE WHEN r = CAST(floor(0.025 * (m - 1)) AS BIGINT) THEN v END) AS low, max(CASE WHEN r = CAST(floor((1 - 0.025) * (m - 1)) AS BIGINT) THEN v END) AS high
  FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS m FROM reps WHERE v IS NOT NULL) z"""


@query(f"""WITH numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality FROM labels), {BOOT},
  reps AS (SELECT rep, sum(quality) / count(*)::DOUBLE AS v FROM draws JOIN numbered USING (pos) GROUP BY rep) {INTERVAL}""")
def q_bootstrap_ci(spark, sf_dir):
    return S.bootstrap(read(spark, sf_dir, "labels").withColumnRenamed("quality", "exact"), "exact", "doc_id", 40, "7")


ALTERED = DIGIT.format("doc_id", 5, 8)


@query(f"""WITH numbered AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality AS a, CASE WHEN {ALTERED} = 0 THEN 1 - quality ELSE quality END AS b FROM labels), {BOOT},
  reps AS (SELECT rep, sum(b) / count(*)::DOUBLE - sum(a) / count(*)::DOUBLE AS v FROM draws JOIN numbered USING (pos) GROUP BY rep) {INTERVAL}""")
def q_paired_bootstrap(spark, sf_dir):
    a = read(spark, sf_dir, "labels").withColumnRenamed("quality", "exact")
    b = a.withColumn("exact", F.when(F.expr(ALTERED) == 0, 1 - F.col("exact")).otherwise(F.col("exact")))
    return S.paired_bootstrap(a, b, "exact", "doc_id", 40, "7")


#: The draws of the operators' reference; the queries above draw 40, as their SQL does.
N_BOOT = 2000


@query()
def q_bootstrap_ci_2000(spark, sf_dir):
    return S.bootstrap(read(spark, sf_dir, "labels").withColumnRenamed("quality", "exact"), "exact", "doc_id", N_BOOT, "7")


@query()
def q_paired_bootstrap_2000(spark, sf_dir):
    a = read(spark, sf_dir, "labels").withColumnRenamed("quality", "exact")
    b = a.withColumn("exact", F.when(F.expr(ALTERED) == 0, 1 - F.col("exact")).otherwise(F.col("exact")))
    return S.paired_bootstrap(a, b, "exact", "doc_id", N_BOOT, "7")


RATED = f"SELECT doc_id % 4 AS grp, quality = 0 AS a, CASE WHEN {ALTERED} = 0 THEN quality <> 0 ELSE quality = 0 END AS b FROM labels"


@query(f"""SELECT grp, n, (aa + bb) / n AS agreement, CASE WHEN pe < 1 THEN ((aa + bb) / n - pe) / (1 - pe) END AS kappa, aa / nullif(aa + ab, 0) AS error_recall, ba / nullif(ba + bb, 0) AS false_errors
  FROM (SELECT *, ((aa + ab) * (aa + ba) + (bb + ba) * (bb + ab)) / (n * n) AS pe FROM (SELECT grp, count(*) AS n, count_if(a AND b)::DOUBLE AS aa, count_if(a AND NOT b)::DOUBLE AS ab, count_if(NOT a AND b)::DOUBLE AS ba, count_if(NOT a AND NOT b)::DOUBLE AS bb FROM ({RATED}) r GROUP BY 1) s) t""")
def q_kappa_table(spark, sf_dir):
    x = read(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("grp"), (F.col("quality") == 0).alias("a"), F.when(F.expr(ALTERED) == 0, F.col("quality") != 0).otherwise(F.col("quality") == 0).alias("b"))
    return S.kappa_table(x, ["grp"], "a", "b")


@query("SELECT CASE WHEN quality = 1 THEN 'found' ELSE 'lost' END AS state, toxic = 1 AS included, count(*) AS n FROM labels GROUP BY ALL")
def q_value_cells(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    return l.groupBy(F.when(F.col("quality") == 1, "found").otherwise("lost").alias("state"), (F.col("toxic") == 1).alias("included")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, [CASE WHEN toxic = 0 AND {ALTERED} = 0 THEN '누락' WHEN toxic = 0 THEN '포함' ELSE '오류' END, CASE WHEN quality = 0 THEN '누락' ELSE '포함' END] AS verdicts FROM labels""")
def q_hybrid_verdicts(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    v = F.array(F.when(F.col("toxic") == 0, "포함").otherwise("오류"), F.lit("포함"))
    return l.select("doc_id", D.overlay(v, F.array(F.expr(ALTERED) != 0, F.col("quality") != 0), "포함", "누락").alias("verdicts"))


# --- joins, contamination, choosing


@query("SELECT lang, count(*) AS n, count_if(seen)::BIGINT AS overlap FROM (SELECT lang, text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS seen FROM documents WHERE doc_id % 2 = 1) x GROUP BY 1")
def q_overlap_split(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    train = d.filter("doc_id % 2 = 0").select("text").distinct().withColumn("seen", F.lit(True))
    test = d.filter("doc_id % 2 = 1").join(train, "text", "left")
    return test.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("seen").alias("overlap"))


RECORD_KEY = "SELECT l_orderkey AS item, list_sort(list(l_returnflag || l_linestatus)) AS record FROM lineitem GROUP BY 1"


@query(f"WITH r AS ({RECORD_KEY}) SELECT item FROM r WHERE item % 3 = 0 AND record IN (SELECT record FROM r WHERE item % 3 <> 0)")
def q_overlap_record(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_list(F.concat("l_returnflag", "l_linestatus"))).alias("record"))
    return r.filter("item % 3 = 0").join(r.filter("item % 3 <> 0").select("record").distinct(), "record", "left_semi").select("item")


@query("""WITH t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 97 = 0) SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM t))""")
def q_contamination_anti(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))  # noqa: E741
    o = read(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey")
    return C.without_contaminated(o.filter("o_orderkey % 97 = 0"), o.filter("o_orderkey % 97 <> 0"), "parts", "o_orderkey").select("o_orderkey")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) x WHERE r <= 3")
def q_take_first(spark, sf_dir):
    return C.take_first(read(spark, sf_dir, "documents"), ["source"], ["doc_id"], 3).select("source", "doc_id")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) x ORDER BY r, lang, doc_id LIMIT 50")
def q_round_robin(spark, sf_dir):
    return C.round_robin(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 50).select("doc_id", "lang")


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY min(doc_id), source) AS g, count(*) OVER () AS k FROM documents GROUP BY source)
  SELECT d.source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) d JOIN g ON d.source = g.source WHERE r <= 53 // k + CASE WHEN g > k - 53 % k THEN 1 ELSE 0 END""")
def q_quota(spark, sf_dir):
    return C.quota(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 53).select("source", "doc_id")


@query("""WITH f AS (SELECT *, md5('shots:' || cast(doc_id AS STRING)) AS h FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS r FROM f)
  SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS q FROM a WHERE r = 1) b WHERE q <= 2""")
def q_few_shot(spark, sf_dir):
    return C.few_shot(read(spark, sf_dir, "documents"), "lang", "source", "doc_id", 2, "shots").select("lang", "source", "doc_id")


@query("""WITH f AS (SELECT doc_id, quality, toxic, md5('3:' || cast(doc_id AS STRING)) AS h FROM labels),
  a AS (SELECT *, 'low' AS stratum FROM f WHERE quality = 0 AND doc_id % 10 <> 0 ORDER BY h, doc_id LIMIT 4),
  b AS (SELECT *, 'toxic' AS stratum FROM f WHERE toxic = 1 AND doc_id % 10 <> 0 AND h > (SELECT max(h) FROM a) ORDER BY h, doc_id LIMIT 4)
  SELECT doc_id, stratum FROM a UNION ALL SELECT doc_id, stratum FROM b""")
def q_stratified_draw(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    return C.stratified_draw(l, [("low", F.col("quality") == 0, 4), ("toxic", F.col("toxic") == 1, 4)], "doc_id", "3", F.col("doc_id") % 10 == 0).select("doc_id", "stratum")


@query("SELECT l_orderkey, CAST(floor((l_linenumber - 1) / 3) AS BIGINT) AS chunk, least(3, n - floor((l_linenumber - 1) / 3) * 3)::BIGINT AS size FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) x")
def q_accum_plan(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(W.partitionBy("l_orderkey")))  # noqa: E741
    chunk, size = C.chunks(F.col("n"), F.col("l_linenumber") - 1, 3)
    return l.select("l_orderkey", chunk.cast("long").alias("chunk"), size.cast("long").alias("size"))


CANDIDATES = "SELECT o_orderpriority AS name, count(*) AS n, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*)::DOUBLE END AS exact, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) / count(*)::DOUBLE AS wrong FROM orders GROUP BY 1"


def _candidates(spark, sf_dir):
    share = lambda v: S.ratio(F.sum((F.col("o_orderstatus") == v).cast("int")), F.count("*"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"), share("F").alias("exact"), share("P").alias("wrong"))
    return o.withColumn("exact", F.when(~F.col("name").startswith("1"), F.col("exact")))


@query(f"SELECT name, row_number() OVER (ORDER BY exact DESC NULLS LAST, wrong ASC NULLS LAST, name) AS place FROM ({CANDIDATES}) c")
def q_pick_order(spark, sf_dir):
    w = W.orderBy(F.desc_nulls_last("exact"), F.asc_nulls_last("wrong"), "name")  # few candidates
    return _candidates(spark, sf_dir).select("name", F.row_number().over(w).cast("long").alias("place"))


@query(f"SELECT name, exact FROM ({CANDIDATES}) c WHERE exact > 0.1 AND wrong < 0.9 ORDER BY exact DESC, name DESC LIMIT 1")
def q_adoption_decision(spark, sf_dir):
    ok = _candidates(spark, sf_dir).filter("exact > 0.1 AND wrong < 0.9")
    return ok.agg(F.max_by("name", F.struct("exact", "name")).alias("name"), F.max("exact").alias("exact")).filter("name IS NOT NULL")


# --- noisy copies and audit


@query("SELECT p_brand, sum(levenshtein(p_name, replace(p_name, 'a', '')))::BIGINT AS edits, sum(length(p_name))::BIGINT AS chars, sum(levenshtein(p_name, replace(p_name, 'a', ''))) / nullif(sum(length(p_name)), 0)::DOUBLE AS cer FROM part GROUP BY 1")
def q_cer(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("heard", F.replace("p_name", F.lit("a"), F.lit("")))
    return D.error_rate(p, ["p_brand"], "p_name", "heard")


@query(f"SELECT o_orderkey, CASE WHEN {DIGIT.format('o_orderkey', 6, 3)} = 0 THEN 1 ELSE 0 END::BIGINT AS wrong FROM orders")
def q_wrong_digit_runs(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("written", F.concat(F.lit("번호 "), F.lpad(F.col("o_orderkey").cast("string"), 9, "7")))
    heard = F.when(F.expr(DIGIT.format("o_orderkey", 6, 3)) == 0, F.concat("written", F.lit("0"))).otherwise(F.col("written"))
    return o.select("o_orderkey", D.wrong_digit_runs(F.col("written"), heard).alias("wrong"))


TURN_KEY = "conv_id * 1000 + turn"


@query(f"""SELECT count(*) AS turns, count_if(m > 1)::BIGINT AS same, count_if(m = 1)::BIGINT AS different, count_if(m = 0)::BIGINT AS missing FROM (SELECT {DIGIT.format(TURN_KEY, 7, 5)} AS m FROM conversations) x""")
def q_identity(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    other = c.withColumn("m", F.expr(DIGIT.format(TURN_KEY, 7, 5))).filter("m <> 0").withColumn("text", F.when(F.col("m") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return D.identity(c, other, ["conv_id", "turn"], "text")


@query(f"""WITH r AS (SELECT l_orderkey, 'R' || cast(k AS STRING) AS run, k % 2 AS grp, CASE WHEN {DIGIT.format('l_orderkey * 10 + k', 8, 4)} < 2 THEN 'x' ELSE 'y' END AS s FROM lineitem, range(3) v(k) WHERE l_linenumber = 1)
  SELECT l_orderkey, s AS structure, count(DISTINCT grp) AS groups, count(DISTINCT run) AS runs, count(DISTINCT grp) >= 2 AS agreed FROM r GROUP BY 1, 2""")
def q_consensus_audit(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))  # noqa: E741
    rows = l.select("l_orderkey", F.concat(F.lit("R"), F.col("k").cast("string")).alias("run"), (F.col("k") % 2).alias("grp"), F.expr(DIGIT.format("l_orderkey * 10 + k", 8, 4)).alias("m"))
    return D.consensus(rows, "l_orderkey", F.when(F.col("m") < 2, "x").otherwise("y"), "grp", "run", 2)


@query(f"""SELECT count(*) AS turns, count_if(m = 0)::BIGINT AS hits, count_if(m > 0 AND length(text) > 0)::BIGINT AS todo, count_if(m > 0 AND coalesce(length(text), 0) = 0)::BIGINT AS silent FROM (SELECT text, {DIGIT.format(TURN_KEY, 9, 3)} AS m FROM conversations) x""")
def q_synthesis_plan(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("m", F.expr(DIGIT.format(TURN_KEY, 9, 3)))
    cache = c.filter("m = 0").select(F.col("conv_id").alias("ci"), F.col("turn").alias("ct"), F.lit(True).alias("hit"))
    j = c.join(cache, (F.col("conv_id") == F.col("ci")) & (F.col("turn") == F.col("ct")), "left")
    miss, words = F.col("hit").isNull(), F.coalesce(F.length("text"), F.lit(0)) > 0
    return j.agg(F.count("*").alias("turns"), F.count_if("hit").alias("hits"), F.count_if(miss & words).alias("todo"), F.count_if(miss & ~words).alias("silent"))


@query(f"""SELECT o_orderkey, '주문번호 D' || lpad(cast(o_orderkey AS STRING), 7, '0') || '이에요' AS text FROM orders""")
def q_id_itn(spark, sf_dir):
    names = "공일이삼사오육칠팔구"
    said = F.translate(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), "0123456789", names)
    return read(spark, sf_dir, "orders").select("o_orderkey", P.spoken_ids(F.concat(F.lit("주문번호 디 "), said, F.lit("이에요"))).alias("text"))


@query("""SELECT p_partkey, 'id ' || cast(p_partkey + 1 AS STRING) || ', again ' || cast(p_partkey + 1 AS STRING) || ' not 0' || cast(p_partkey AS STRING) AS text, 2 AS n FROM part""")
def q_substitute(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("id "), k, F.lit(", again "), k, F.lit(" not 0"), k)
    return read(spark, sf_dir, "part").select("p_partkey", P.substitute(text, k, (F.col("p_partkey") + 1).cast("string")).alias("r")).select("p_partkey", "r.text", "r.n")


@query("SELECT p_partkey, upper(regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g')) AS letters FROM part")
def q_letters_only(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", R.letters_only(F.col("p_name")).alias("letters"))


# --- generation, counterfactual copies, streams

CATALOGUE = {
    "refund": {
        "outcomes": {"해결": 3, "이관": 1}, "slots": [("order", "주문번호", "id", "D#######"), ("sum", "금액", "amount", "1000-90000-100")], "extra": 0.3, "distractor": 0.5, "events": {"verify": 0.7, "hold": 0.2},
        "actions": {"해결": ["환불"], "이관": ["이관"]}, "facts": ["{order} 주문의 환불을 원함", "{sum}을 돌려줌"],
    },
    "visit": {
        "outcomes": {"해결": 1, "미해결": 1}, "slots": [("day", "날짜", "date", ""), ("new_day", "날짜", "date", ""), ("hour", "시각", "time", "")], "extra": 0.1, "distractor": 0.0, "ordered": [("day", "new_day")],
        "facts": ["{day}에서 {new_day}로 방문일을 바꿈"],
    },
}


@query()
def q_spec_sampler(spark, sf_dir):
    from ..operators import generate as G

    keys = read(spark, sf_dir, "orders").select(F.concat(F.lit("train-"), F.col("o_orderkey").cast("string")).alias("item_id"), F.when(F.col("o_orderkey") % 2 == 0, "refund").otherwise("visit").alias("scenario"))
    return G.sample_specs(keys, CATALOGUE, "1")


def _numbered_dialogues(spark, sf_dir):
    u = utterances(spark, sf_dir).withColumn("value", F.concat(F.lit("D"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")))
    turn = lambda s, t: F.struct(F.lit(s).alias("speaker"), t.alias("text"))
    return u.select(F.col("o_orderkey").cast("string").alias("item_id"), F.array(turn("agent", F.lit("hello")), turn("caller", F.col("text")), turn("agent", F.concat("value", F.lit(" 맞으시죠")))).alias("turns"), F.array("value").alias("values"))


@query("SELECT cast(o_orderkey AS STRING) AS item_id, true AS ok, 0::BIGINT AS old_left, 2::BIGINT AS new_there FROM orders")
def q_perturb_swap(spark, sf_dir):
    """Amounts are left out: one that shares four digits with the number would keep them in the text."""
    from ..operators import generate as G

    bare = F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), F.regexp_replace(t["text"], " 금액 [0-9]+원", "").alias("text")))
    s = G.swap_numbers(_numbered_dialogues(spark, sf_dir).withColumn("turns", bare), "1")
    having = lambda v: F.size(F.filter("turns", lambda t: t["text"].contains(F.get(v, F.lit(0))))).cast("long")
    return s.select("item_id", "ok", having("old").alias("old_left"), having("new").alias("new_there"))


@query("SELECT cast(o_orderkey AS STRING) AS item_id, true AS grown, true AS placed FROM orders")
def q_perturb_neutral(spark, sf_dir):
    from ..operators import generate as G

    lines = {"agent": [("잠시만요", "네"), ("확인 중입니다", "기다릴게요")], "caller": [("네", "확인 중입니다")]}
    n = G.insert_neutral(_numbered_dialogues(spark, sf_dir), lines, "1")
    fits = F.col("inserted").isin(2, 4) & (F.size("turns") == 3 + F.col("inserted"))
    return n.select("item_id", fits.alias("grown"), (F.col("at") == 2).alias("placed"))


@query("SELECT cast(o_orderkey AS STRING) AS item_id, 'hello|do it|no|' || " + UTTERANCE + " || '|D' || lpad(cast(o_orderkey AS STRING), 7, '0') || ' 맞으시죠' AS texts FROM orders")
def q_perturb_inject(spark, sf_dir):
    from ..operators import generate as G

    d = _numbered_dialogues(spark, sf_dir)
    return d.select("item_id", F.array_join(F.transform(G.inject(F.col("turns"), F.lit("do it"), "no", ("agent", "caller")), lambda t: t["text"]), "|").alias("texts"))


@query("SELECT o_orderkey, cast(o_orderkey AS STRING) || '7' AS span FROM orders")
def q_heard_span(spark, sf_dir):
    from ..operators import generate as G

    key = F.col("o_orderkey").cast("string")
    return read(spark, sf_dir, "orders").select("o_orderkey", G.heard_span(F.concat(F.lit("aa "), key, F.lit(" bb")), F.concat(F.lit("ac "), key, F.lit("7 bb")), key).alias("span"))


@query(f"""SELECT o_orderpriority, count(*) AS n, count_if(m <> 0)::BIGINT AS eligible, count_if(m > 1)::BIGINT AS followed, count_if(m > 1) / nullif(count_if(m <> 0), 0)::DOUBLE AS rate
  FROM (SELECT o_orderpriority, {DIGIT.format('o_orderkey', 10, 6)} AS m FROM orders) x GROUP BY 1""")
def q_swap_report(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("m", F.expr(DIGIT.format("o_orderkey", 10, 6)))
    control = o.select("o_orderkey", "o_orderpriority", (F.col("m") != 0).alias("eligible"))
    run = o.select("o_orderkey", (F.col("m") > 1).alias("followed"))
    g = control.join(run, "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("followed")).alias("followed"))
    return g.withColumn("rate", S.ratio(F.col("followed"), F.col("eligible")))


def checkpoint_dir(spark: SparkSession, name: str) -> str:
    """A folder for a stream's state that driver and executors share; only a local session without one has a temporary folder."""
    import tempfile

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='stream-')).rstrip('/')}/{name}"


@query("SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY 1")
def s_request_stats(spark, sf_dir):
    """The event log as a stream, run to its end; the table that its complete mode leaves."""
    import uuid

    from ..streaming.stats import stream_outcomes

    batch = read(spark, sf_dir, "events")
    log = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")
    name = f"requests_{uuid.uuid4().hex}"
    q = stream_outcomes(log, "event_type").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint_dir(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("""SELECT form, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'as_written' WHEN 1 THEN 'split_found' WHEN 2 THEN 'hangul_digit_names' WHEN 3 THEN 'lost_fewer' ELSE 'lost_changed' END AS form FROM orders) x GROUP BY 1""")
def q_tracking_forms(spark, sf_dir):
    from ..operators import generate as G

    number = F.concat(F.lit("12"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("34"))
    m = F.col("o_orderkey") % 5
    heard = (
        F.when(m == 0, number).when(m == 1, F.concat(F.substring(number, 1, 6), F.lit(", "), F.expr("substring(concat('12', lpad(o_orderkey, 8, '0'), '34'), 7)")))
        .when(m == 2, "일이삼사오").when(m == 3, "12").otherwise(F.translate(number, "0123456789", "1234567890"))
    )
    o = read(spark, sf_dir, "orders")
    return o.groupBy(G.tracking_form(F.concat(F.lit("n "), number, F.lit(" ok")), F.concat(F.lit("n "), heard, F.lit(" ok")), number).alias("form")).agg(F.count("*").alias("n"))
from . import calls as _calls  # noqa: E402, F401  (registers its queries)
from . import reviews as _reviews  # noqa: E402, F401
