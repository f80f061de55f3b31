"""Queries over replies to calls: item scores, metrics, identifier checks, guarded joins. A call is made of each order.

The SQL states what each kind of reply must score, by a table of the kinds; it knows nothing of how the operators find it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import guarded as J
from ..operators import items as I
from ..operators import scoring as S
from .queries import conversations, query, read, utterances

RECORD = "struct<category:string,resolution:string,entities:array<struct<type:string,value:string>>,actions_taken:array<string>,follow_up:struct<required:boolean,codes:array<string>>,summary:string>"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
KIND = "o_orderkey % 11"
ID_KIND = "o_orderkey % 5"


def catalogue(spark) -> DataFrame:
    kinds = {"주문번호": "id", "금액": "amount", "날짜": "date", "구분": "text"}
    rows = [(d, kinds, {"주문번호": r"D\d{7}"}, PRIORITIES, ["환불", "안내"], ["A", "B"]) for d in "FOP"]
    return spark.createDataFrame(rows, I.CATALOGUE)


def entity(kind: str, value):
    return F.struct(F.lit(kind).alias("type"), (F.lit(value) if isinstance(value, str) else value).alias("value"))


def record(category, resolution, entities, actions, required, codes):
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        lit(category).alias("category"), lit(resolution).alias("resolution"), entities.alias("entities"), actions.alias("actions_taken"),
        F.struct(required.alias("required"), codes.alias("codes")).alias("follow_up"), F.lit("s").alias("summary"),
    ).cast(RECORD)


def words(*xs: str):
    return F.array(*map(F.lit, xs))


def calls(spark, sf_dir) -> DataFrame:
    """Items as ``score_items`` takes them, with replies of eleven kinds, and doc_id-like number n."""
    m = F.expr(KIND)
    key, price = F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.floor("o_totalprice")
    number, amount, day, part = entity("주문번호", F.concat(F.lit("D"), key)), entity("금액", F.concat(price.cast("string"), F.lit("원"))), entity("날짜", F.date_format("o_orderdate", "M월 d일")), entity("구분", "오후")
    full = F.array(number, amount, day, part)
    pred = (
        F.when(m == 5, F.array(number, entity("금액", F.concat(F.format_number(price, 0), F.lit(" 원"))), day, part)).when(m == 6, F.array(number, amount, day, part, entity("주문번호", F.concat(F.lit("d-"), key))))
        .when(m == 7, F.array(number, amount, part)).when(m == 8, F.array(number, amount, day, part, entity("모름", "xyz"))).when(m == 10, F.array(number, entity("금액", ""), day, part)).otherwise(full)
    )
    odd, both, codes = F.col("o_orderkey") % 2 == 0, words("환불", "안내"), words("A", "B")
    reply = record(
        F.when(m == 3, "Z").otherwise(F.col("o_orderpriority")), F.when(m == 4, "이관").otherwise("해결"), pred, F.when(m == 9, words("환불", "환불", "Q", "Q")).otherwise(both),
        F.when(m == 10, ~odd).otherwise(odd), F.when(m == 10, words("B", "A", "B")).otherwise(codes),
    )
    return utterances(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("domain"), record(F.col("o_orderpriority"), "해결", full, both, odd, codes).alias("gold"),
        (m != 1).alias("json_ok"), (~m.isin(1, 2)).alias("schema_ok"), F.when(~m.isin(1, 2), reply).alias("record"), F.col("text").alias("transcript"), (F.col("o_orderkey") % 3 == 0).alias("spoken"),
    )


#: kind, json, schema, category, resolution, entity tp, fp, fn, predicted, not in the text, action tp, fp, fn, required, codes, off list, exact
SCORED = """(VALUES (0, true, true, true, true, 4, 0, 0, 4, 0, 2, 0, 0, true, true, 0, true), (1, false, false, false, false, 0, 0, 4, 0, 0, 0, 0, 2, false, false, 0, false),
  (2, true, false, false, false, 0, 0, 4, 0, 0, 0, 0, 2, false, false, 0, false), (3, true, true, false, true, 4, 0, 0, 4, 0, 2, 0, 0, true, true, 1, false),
  (4, true, true, true, false, 4, 0, 0, 4, 0, 2, 0, 0, true, true, 0, false), (5, true, true, true, true, 4, 0, 0, 4, 0, 2, 0, 0, true, true, 0, true),
  (6, true, true, true, true, 4, 1, 0, 5, 0, 2, 0, 0, true, true, 0, false), (7, true, true, true, true, 3, 0, 1, 3, 0, 2, 0, 0, true, true, 0, false),
  (8, true, true, true, true, 4, 1, 0, 5, 1, 2, 0, 0, true, true, 1, false), (9, true, true, true, true, 4, 0, 0, 4, 0, 1, 1, 1, true, true, 1, false),
  (10, true, true, true, true, 3, 1, 1, 4, 1, 2, 0, 0, false, true, 0, false))
  AS v(m, json_ok, schema_ok, category_ok, resolution_ok, entity_tp, entity_fp, entity_fn, entity_pred, entity_hallucinated, action_tp, action_fp, action_fn, follow_required_ok, follow_codes_ok, off_list, exact)"""
NUMBERS = ("entity_tp", "entity_fp", "entity_fn", "entity_pred", "entity_hallucinated", "action_tp", "action_fp", "action_fn", "off_list")
SCORE_SQL = f"""SELECT cast(o_orderkey AS STRING) AS item_id, o_orderstatus AS domain, o_orderpriority AS gold_category, json_ok, schema_ok, CASE WHEN schema_ok THEN CASE WHEN m = 3 THEN 'Z' ELSE o_orderpriority END END AS pred_category,
  category_ok, resolution_ok, {', '.join(f'{c}::BIGINT AS {c}' for c in NUMBERS)}, follow_required_ok, follow_codes_ok, exact FROM orders JOIN {SCORED} ON {KIND} = m"""
RATES = {"json": "json_ok", "schema": "schema_ok", "exact": "exact", "category_acc": "category_ok", "resolution_acc": "resolution_ok", "follow_up_acc": "follow_required_ok AND follow_codes_ok", "off_list": "off_list > 0"}
METRIC_SQL = ", ".join(f"count_if({c}) / count(*)::DOUBLE AS {n}" for n, c in RATES.items()) + """, sum(entity_tp) / nullif(sum(entity_tp + entity_fp), 0)::DOUBLE AS entity_p, sum(entity_tp) / nullif(sum(entity_tp + entity_fn), 0)::DOUBLE AS entity_r,
  2 * sum(entity_tp) / nullif(sum(2 * entity_tp + entity_fp + entity_fn), 0)::DOUBLE AS entity_f1, sum(entity_hallucinated) / nullif(sum(entity_pred), 0)::DOUBLE AS hallucination, 2 * sum(action_tp) / nullif(sum(2 * action_tp + action_fp + action_fn), 0)::DOUBLE AS action_f1"""


def macro_sql(where: str = "true", by: str = "") -> str:
    """Macro F1 over (domain, gold category): an item whose category is right is the only true positive of its label; kind 3 gives Z."""
    group, key = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"SELECT {key}round(avg(2 * tp / (n + p)::DOUBLE), 9) AS category_macro_f1 FROM (SELECT domain, gold_category, count(*) AS n, count_if(category_ok) AS tp, count_if(category_ok) AS p FROM s WHERE {where} GROUP BY ALL) l {group}"


def rounded():
    return F.round("category_macro_f1", 9).alias("category_macro_f1")


def scores(spark, sf_dir) -> DataFrame:
    return I.score_items(calls(spark, sf_dir), catalogue(spark))


@query(SCORE_SQL)
def q_item_score(spark, sf_dir):
    return scores(spark, sf_dir)


@query(f"SELECT domain, count_if(exact)::BIGINT AS exact, count(*) AS n FROM ({SCORE_SQL}) s GROUP BY 1")
def q_exact(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("domain").agg(F.count_if("exact").alias("exact"), F.count("*").alias("n"))


@query(f"WITH s AS ({SCORE_SQL}) SELECT count(*) AS n, {METRIC_SQL}, max(m.category_macro_f1) AS category_macro_f1 FROM s, ({macro_sql()}) m")
def q_metric_13(spark, sf_dir):
    s = I.summarise(scores(spark, sf_dir))
    return s.select("n", *I.METRICS, rounded())


@query(f"""WITH s AS ({SCORE_SQL}) SELECT 'all' AS part, NULL::VARCHAR AS domain, count(*) AS n, {METRIC_SQL}, max(m.category_macro_f1) AS category_macro_f1 FROM s, ({macro_sql()}) m
  UNION ALL SELECT 'schema_ok_only', NULL, count(*), {METRIC_SQL}, max(m.category_macro_f1) FROM s, ({macro_sql('schema_ok')}) m WHERE schema_ok
  UNION ALL SELECT 'domain', s.domain, count(*), {METRIC_SQL}, max(m.category_macro_f1) FROM s JOIN ({macro_sql(by='domain')}) m ON s.domain = m.domain GROUP BY s.domain""")
def q_summary_table(spark, sf_dir):
    return I.summary_table(scores(spark, sf_dir)).select("part", "domain", "n", *I.METRICS, rounded())


@query(f"SELECT type, count_if(m = 8 AND type = '모름' OR m = 10 AND type = '금액')::BIGINT AS unfound, count(*) AS items FROM orders JOIN {SCORED} ON {KIND} = m, (VALUES ('모름'), ('금액')) AS t(type) WHERE schema_ok GROUP BY 1")
def q_hallucination(spark, sf_dir):
    x = calls(spark, sf_dir).filter("schema_ok").join(catalogue(spark).select("domain", "kinds"), "domain").withColumn("index", V.text_index(F.col("transcript")))
    x = x.withColumn("lost", F.transform(I.unfound(F.col("record.entities"), F.col("kinds"), F.col("index"), F.col("spoken")), lambda e: e["type"]))
    x = x.select(F.explode(words("모름", "금액")).alias("type"), "lost")
    return x.groupBy("type").agg(F.sum(F.size(F.filter("lost", lambda t: t == F.col("type")))).cast("long").alias("unfound"), F.count("*").alias("items"))


@query(f"SELECT CASE {KIND} WHEN 8 THEN '모름' ELSE '금액' END AS type, 0::BIGINT AS restored, count(*) AS invented, count_if({KIND} = 10)::BIGINT AS empty, 0::BIGINT AS placeholder FROM orders WHERE {KIND} IN (8, 10) GROUP BY 1")
def q_unfound_split(spark, sf_dir):
    return I.unfound_split(calls(spark, sf_dir), catalogue(spark))


@query("SELECT type, count(*) AS values, count(*) AS found FROM orders, (VALUES ('주문번호'), ('금액'), ('날짜'), ('구분')) AS t(type) GROUP BY 1")
def q_value_survival(spark, sf_dir):
    return I.value_survival(calls(spark, sf_dir), catalogue(spark))[0]


LOST = "(o_orderkey % 7 = 0)"


@query(f"SELECT o_orderstatus AS domain, count(*) AS items, count_if(NOT {LOST})::BIGINT AS all_found FROM orders GROUP BY 1")
def q_items_all_found(spark, sf_dir):
    """The amount is missing from every seventh transcript."""
    x = calls(spark, sf_dir).withColumn("transcript", F.when(F.col("n") % 7 == 0, F.regexp_replace("transcript", " 금액 [0-9]+원", "")).otherwise(F.col("transcript")))
    return I.value_survival(x, catalogue(spark), ["domain"])[1]


def id_calls(spark, sf_dir) -> DataFrame:
    """Replies with one order number (or two, or none): right, of another form, another number, twice, missing; every seventh has no record."""
    c, m = calls(spark, sf_dir), F.col("n") % 5
    key = F.lpad(F.col("n").cast("string"), 7, "0")
    right = F.concat(F.lit("D"), key)
    value = F.when(m == 1, F.concat(F.lit("Q"), key)).when(m == 2, F.concat(F.lit("D9"), F.substring(key, 2, 6))).otherwise(right)
    ids = F.when(m == 4, F.array().cast("array<struct<type:string,value:string>>")).when(m == 3, F.array(entity("주문번호", right), entity("주문번호", right))).otherwise(F.array(entity("주문번호", value)))
    none = words().cast("array<string>")
    return c.withColumn("record", F.when(F.col("n") % 7 != 0, record("1-URGENT", "해결", ids, none, F.lit(False), none)))


WRITTEN = {"주문번호": r"D\d{7}"}
ID_ROWS = f"""SELECT cast(o_orderkey AS STRING) AS item_id, k::BIGINT AS pos, o_orderstatus AS domain, k = 0 AND m IN (0, 3) AS correct, CASE WHEN m = 1 THEN ['format'] WHEN m = 2 THEN ['not_in_transcript'] ELSE []::VARCHAR[] END AS reasons,
  m <> 1 AS written_ok, CASE WHEN m = 3 AND k = 1 THEN 'same_length' END AS shape FROM (SELECT *, {ID_KIND} AS m FROM orders WHERE o_orderkey % 7 <> 0) o, (VALUES (0), (1)) AS c(k) WHERE m <> 4 AND (k = 0 OR m = 3)"""


def _identifiers(spark, sf_dir):
    return I.identifier_report(id_calls(spark, sf_dir), catalogue(spark), WRITTEN)


@query(f"SELECT item_id, pos, correct, reasons, written_ok, shape FROM ({ID_ROWS}) r")
def q_guard_rows(spark, sf_dir):
    return _identifiers(spark, sf_dir).select("item_id", "pos", "correct", "reasons", "written_ok", "shape")


@query(f"""SELECT domain, count(*) AS predicted, count_if(correct)::BIGINT AS correct, count_if(NOT correct)::BIGINT AS wrong, 0::BIGINT AS flagged_correct, count_if(len(reasons) > 0)::BIGINT AS flagged_wrong,
  0::BIGINT AS written_rule_correct, 0::BIGINT AS written_rule_wrong FROM ({ID_ROWS}) r GROUP BY 1""")
def q_guard_report(spark, sf_dir):
    return I.guard_report(_identifiers(spark, sf_dir).join(calls(spark, sf_dir).select("item_id", "domain"), "item_id"), ["domain"])


@query(f"SELECT count_if({ID_KIND} IN (1, 2, 4) AND o_orderkey % 7 <> 0)::BIGINT AS gold_ids_not_predicted, count_if(o_orderkey % 7 = 0)::BIGINT AS rows_without_record FROM orders")
def q_guard_missed(spark, sf_dir):
    return I.missed_identifiers(id_calls(spark, sf_dir), catalogue(spark))


@query(f"SELECT shape, count(*) AS n FROM ({ID_ROWS}) r WHERE NOT correct AND len(reasons) = 0 GROUP BY 1")
def q_guard_shapes(spark, sf_dir):
    return _identifiers(spark, sf_dir).filter("shape IS NOT NULL").groupBy("shape").agg(F.count("*").alias("n"))


@query(f"SELECT item_id, array_to_string(reasons, '+') AS reasons FROM ({ID_ROWS}) r WHERE len(reasons) > 0")
def q_verify_entities(spark, sf_dir):
    f = I.identifier_flags(_identifiers(spark, sf_dir))
    return f.select("item_id", F.array_join(F.flatten(F.transform("flags", lambda x: x["reasons"])), "+").alias("reasons"))


def _runs(spark, sf_dir, shift: int = 0) -> DataFrame:
    """Scores of a run; a shifted one has other kinds of replies for the same items."""
    s = scores(spark, sf_dir)
    return s if not shift else s.withColumn("exact", F.col("item_id").cast("long") % 4 == shift)


@query(f"SELECT lang, count(*) AS n, count_if(exact)::BIGINT AS exact FROM (SELECT * FROM ({SCORE_SQL}) s) s JOIN (SELECT cast(o_orderkey AS STRING) AS item_id, o_orderpriority AS lang FROM orders) d USING (item_id) GROUP BY 1")
def q_run_join(spark, sf_dir):
    """Run rows with their items; an item that the data set lacks would fail the read."""
    known = calls(spark, sf_dir).select("item_id", F.col("gold.category").alias("lang"))
    return J.lookup(scores(spark, sf_dir), known, ["item_id"]).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"))


@query(f"SELECT count(*) AS n, count_if(a.exact)::BIGINT AS control, count_if(o_orderkey % 4 = 1)::BIGINT AS run, count_if(o_orderkey % 3 = 0)::BIGINT AS changed FROM ({SCORE_SQL}) a JOIN orders ON item_id = cast(o_orderkey AS STRING)")
def q_paired_runs(spark, sf_dir):
    made = calls(spark, sf_dir).select("item_id", (F.col("n") % 3 == 0).alias("changed"))
    p = J.paired_runs(_runs(spark, sf_dir), _runs(spark, sf_dir, 1), made, "item_id")
    return p.agg(F.count("*").alias("n"), F.count_if("control.exact").alias("control"), F.count_if("run.exact").alias("run"), F.count_if("made.changed").alias("changed"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'item' ELSE 'key' END AS way, CASE WHEN doc_id % 3 = 0 THEN quality ELSE toxic END AS label FROM labels")
def q_label_join(spark, sf_dir):
    l = read(spark, sf_dir, "labels")  # noqa: E741
    sample = l.select("doc_id", F.col("doc_id").cast("string").alias("item_id"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.when(F.col("doc_id") % 3 == 0, "hand").otherwise("new").alias("stratum"))
    item = l.select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").alias("label"), F.lit("item").alias("way"))
    key = l.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.col("toxic").alias("label"), F.lit("key").alias("way"))
    return J.labelled(sample, key, item, "hand").select("doc_id", "way", "label")


@query("""SELECT cast(conv_id AS STRING) AS item_id, string_agg(CASE WHEN coalesce(length(text), 0) = 0 THEN '' ELSE '<' || text || '>' END, '|' ORDER BY turn, role, text) AS heard, string_agg(coalesce(text, ''), '|' ORDER BY turn, role, text) AS written
  FROM conversations GROUP BY 1""")
def q_heard_items(spark, sf_dir):
    c = conversations(spark, sf_dir).select(F.col("conv_id").cast("string").alias("item_id"), "turns")
    turns = c.select("item_id", F.posexplode("turns").alias("turn", "t")).select("item_id", F.col("turn").cast("long").alias("turn"), F.sha2(F.col("t.text"), 256).alias("key"), (F.length("t.text") == 0).alias("silent"), "t.text")
    heard = turns.filter("NOT silent").groupBy("key").agg(F.concat(F.lit("<"), F.any_value("text"), F.lit(">")).alias("heard"))
    h = J.heard_items(c, turns.drop("text"), heard)
    return h.select("item_id", F.array_join(F.transform("turns", lambda t: t["text"]), "|").alias("heard"), F.array_join("written", "|").alias("written"))


@query("SELECT count(*) AS n, count_if(o_orderkey % 6 > 1)::BIGINT AS identical FROM orders")
def q_reply_equality(spark, sf_dir):
    u = utterances(spark, sf_dir).select("o_orderkey", "text")
    other = u.filter("o_orderkey % 6 <> 0").withColumn("text", F.when(F.col("o_orderkey") % 6 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return J.reply_equality(u, other, "o_orderkey", "text")


@query("SELECT 2 * count(*)::BIGINT AS facts, sum(CASE WHEN quality = toxic THEN 2 ELSE 1 END) / (2 * count(*))::DOUBLE AS agreement FROM labels WHERE doc_id % 5 > 2")
def q_rater_agreement(spark, sf_dir):
    """Of five labelled documents one is missing at the second rater, one failed, one has too few verdicts."""
    l, m = read(spark, sf_dir, "labels").withColumn("item_id", F.col("doc_id").cast("string")), F.col("doc_id") % 5  # noqa: E741
    a = l.select("item_id", F.array(F.col("quality"), F.lit(1)).alias("verdicts"), F.lit(True).alias("ok"))
    b = l.filter(m != 0).select("item_id", F.when(m == 1, F.array(F.lit(1))).otherwise(F.array(F.col("toxic"), F.lit(1))).alias("verdicts"), (m != 2).alias("ok"))
    return J.rater_agreement(a, b)


@query(f"SELECT item_id, schema_ok AND NOT exact AND entity_fp + entity_fn + action_fp + action_fn = 0 AND category_ok AS only_flags, schema_ok AND NOT exact AS wrong FROM ({SCORE_SQL}) s")
def q_wrong_structure(spark, sf_dir):
    """Structures that differ from gold, checked against the scores' exact."""
    x = J.one_to_one(calls(spark, sf_dir).select("item_id", "domain", "gold", "record"), scores(spark, sf_dir).drop("domain"), ["item_id"])
    w = I.checked_structures(x, catalogue(spark))
    clean = F.col("entity_fp") + F.col("entity_fn") + F.col("action_fp") + F.col("action_fn") == 0
    return w.select("item_id", (F.col("schema_ok") & ~F.col("exact") & clean & F.col("category_ok")).alias("only_flags"), F.col("wrong_structure").isNotNull().alias("wrong"))


@query(f"SELECT domain, count_if(m = 0)::BIGINT AS length_stops, count_if(m = 1)::BIGINT AS thinking_items, count_if(m IN (2, 3))::BIGINT AS context_full FROM (SELECT o_orderstatus AS domain, o_orderkey % 6 AS m FROM orders) x GROUP BY 1")
def q_reply_checks(spark, sf_dir):
    m = F.col("o_orderkey") % 6
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("domain"), F.when(m == 0, "length").when(m < 5, "stop").alias("done_reason"), F.when(m == 1, 7).when(m == 2, 0).alias("thinking_chars"), F.when(m != 4, 4000).alias("prompt_tokens"),
        F.when(m == 2, 96).when(m == 3, 97).otherwise(95).alias("completion_tokens"),
    )
    return I.run_checks(o, 4096, ["domain"])


@query()
def q_flag_difference(spark, sf_dir):
    s = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("found"))
    better = s.withColumn("found", F.col("found") | (F.col("doc_id") % 3 == 0))
    return S.flag_difference(s, better, "found", "doc_id", 2000, "5")
