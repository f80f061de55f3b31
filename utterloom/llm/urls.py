"""URL filter: fixed rules first, else an empirical-Bayes host reputation. DataFrame and SQL functions only.

``judge`` sums outcomes once by host, and from there each level from the one below: n, good, and the sum of good^2 / n, which give the
spread of the children's rates around any mean without another pass. Pages meet one row a host; the table of hosts is broadcast
only if it is counted as small, else joined by its key, where adaptive execution splits a hot host's pages.
``reputation_sql`` states the same result as one SQL query of its own; the operator does not use it.

Labelled page outcomes (good or not) are counted by host, summed to registered domain and suffix. Each level's rate is
shrunk towards its parent's through a beta prior: mean = the parent's shrunk rate, concentration = moments of the
children's rates (beta-binomial). A page is blocked if the upper posterior bound of its host's rate of good pages is below
the threshold; a host without labels has its domain's rate, and so on up to the prior of all pages.

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the prior of all pages.
A null page id stays null. Several labels of one page count as good only if all are. Repeated pages are separate rows.
Empty tables: without labels every rate is 1/2 with little weight, so nothing is blocked; without pages there is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
THRESHOLD, BOUND_Z = 0.5, 1.64
#: Hosts of at most so many rows are broadcast (some 50 bytes each).
MOST_BROADCAST = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _case(rules, column: str) -> str:
    out = []
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' OR right(host, {len(host) + 1}) = '.{host}') AND left(path, {len(path)}) = '{path}'"
        out.append(f"WHEN {fits} THEN '{host + path if column == 'rule' else verdict}'")
    return f"CASE {' '.join(out)} END" if out else "CAST(NULL AS STRING)"


def _level(child: str, parent: str, key: str, above: str) -> str:
    """SQL of the beta prior that each ``parent`` row sets for its ``child`` rows: mean is added where the parent is shrunk."""
    return f"""
      SELECT {key}, sum(n) AS n, sum(good) AS good, count(*) AS parts,
        sum(n * (good / n - m) * (good / n - m)) / sum(n) AS spread, max(m) AS m
      FROM (SELECT c.{key}, c.n, c.good, p.m FROM {child} c
            JOIN (SELECT {key}, (sum(good) + 0.5) / (sum(n) + 1.0) AS m FROM {child} GROUP BY {key}) p ON c.{key} = p.{key}) x
      GROUP BY {key}"""


def reputation_sql(pages: str, outcomes: str, rules=RULES, suffixes=SUFFIXES, threshold: float = THRESHOLD, z: float = BOUND_Z) -> str:
    """The result as SQL text, for DuckDB or Spark. ``pages``: page_id, url; ``outcomes``: page_id, good (1 or 0)."""
    two = ", ".join(f"'{s}'" for s in suffixes)
    last = lambda k: f"regexp_extract(host, '([^.]*" + "[.][^.]*" * (k - 1) + ")$', 1)"
    conc = "least(1000.0, greatest(1.0, (m * (1 - m) - spread) / greatest(spread - m * (1 - m) * parts / n, 0.001)))"
    return f"""
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM {pages}),
judged AS (
  SELECT page_id, host, path, {_case(rules, 'rule')} AS rule, {_case(rules, 'verdict')} AS ruled FROM split),
labelled AS (SELECT page_id, min(good) AS good FROM {outcomes} WHERE good IS NOT NULL AND page_id IS NOT NULL GROUP BY page_id),
hosts AS (
  SELECT host, {last(2)} AS two, {last(1)} AS one, CAST(count(*) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS good
  FROM split JOIN labelled ON split.page_id = labelled.page_id GROUP BY host),
named AS (
  SELECT host, n, good, CASE WHEN two IN ({two}) THEN two ELSE one END AS suffix,
    CASE WHEN two IN ({two}) THEN CASE WHEN {last(3)} = '' THEN two ELSE {last(3)} END
         WHEN two = '' THEN one ELSE two END AS domain
  FROM hosts),
domain0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM named GROUP BY domain, suffix),
suffix0 AS (SELECT suffix, 'all' AS world, sum(n) AS n, sum(good) AS good FROM domain0 GROUP BY suffix),
world1 AS ({_level('suffix0', 'world', 'world', '')}),
world2 AS (
  SELECT coalesce(max(m), 0.5) AS mean, coalesce(max({conc}), 1.0) AS conc FROM world1),
suffix1 AS ({_level('domain0', 'suffix', 'suffix', '')}),
suffix2 AS (
  SELECT s.suffix, (s.good + w.mean * w.conc) / (s.n + w.conc) AS mean, {conc} AS conc
  FROM suffix1 s CROSS JOIN world2 w),
domain1 AS ({_level('named', 'domain', 'domain', '')}),
domain2 AS (
  SELECT d.domain, (d.good + s.mean * s.conc) / (d.n + s.conc) AS mean, {conc.replace('m *', 'd.m *').replace('- m)', '- d.m)').replace('parts', 'd.parts').replace('spread', 'd.spread').replace('/ n', '/ d.n')} AS conc
  FROM domain1 d JOIN domain0 o ON d.domain = o.domain JOIN suffix2 s ON o.suffix = s.suffix),
bounded AS (
  SELECT h.host, h.good + d.mean * d.conc AS a, h.n - h.good + (1 - d.mean) * d.conc AS b
  FROM named h JOIN domain2 d ON h.domain = d.domain),
host3 AS (
  SELECT host, a / (a + b) + {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM bounded),
asked AS (
  SELECT page_id, host, path, rule, ruled, {last(2)} AS two, {last(1)} AS one FROM judged),
keyed AS (
  SELECT page_id, host, path, rule, ruled, CASE WHEN two IN ({two}) THEN two ELSE one END AS suffix,
    CASE WHEN two IN ({two}) THEN CASE WHEN {last(3)} = '' THEN two ELSE {last(3)} END
         WHEN two = '' THEN one ELSE two END AS domain
  FROM asked),
domain3 AS (SELECT domain, mean + {z} * sqrt(mean * (1 - mean) / (conc + 1)) AS upper FROM domain2),
suffix3 AS (SELECT suffix, mean + {z} * sqrt(mean * (1 - mean) / (conc + 1)) AS upper FROM suffix2),
world3 AS (SELECT mean + {z} * sqrt(mean * (1 - mean) / (conc + 1)) AS upper FROM world2)
SELECT k.page_id, k.host, k.path, k.rule,
  CASE WHEN k.ruled IS NOT NULL THEN k.ruled
       WHEN coalesce(h.upper, d.upper, s.upper, w.upper) < {threshold} THEN 'block' ELSE 'allow' END AS verdict
FROM keyed k LEFT JOIN host3 h ON k.host = h.host LEFT JOIN domain3 d ON k.domain = d.domain
  LEFT JOIN suffix3 s ON k.suffix = s.suffix CROSS JOIN world3 w"""


#: The page's document is the number in its path.
OUTCOMES_SQL = """(SELECT p.page_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END AS good
  FROM (SELECT page_id, TRY_CAST(regexp_extract(url, '(?s)^.*?://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id FROM {pages}) p
  JOIN {labels} l ON p.doc_id = l.doc_id) o"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last WHEN is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def names(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host. A host that is a suffix, or has one label, is its own domain."""
    labels = F.split(host, "[.]")
    last = lambda k: F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), "."))
    wide = F.coalesce(last(2).isin(*suffixes), F.lit(False)) if suffixes else F.lit(False)
    return F.when(wide, F.coalesce(last(3), last(2))).otherwise(F.coalesce(last(2), last(1))), F.when(wide, last(2)).otherwise(last(1))


def _rolled(children: DataFrame, key: str, *others: str) -> DataFrame:
    """Each parent's counts and the prior that its children's rates give: n, good, m (its own rate), conc."""
    sums = children.groupBy(key, *others).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("s2"), F.count("*").alias("parts"))
    x = sums.withColumn("m", (F.col("good") + 0.5) / (F.col("n") + 1.0))
    x = x.withColumn("spread", (F.col("s2") - 2 * F.col("m") * F.col("good") + F.col("m") * F.col("m") * F.col("n")) / F.col("n"))
    noise = F.col("m") * (1 - F.col("m"))
    conc = (noise - F.col("spread")) / F.greatest(F.col("spread") - noise * F.col("parts") / F.col("n"), F.lit(0.001))
    return x.select(key, *others, "n", "good", "m", F.least(F.lit(1000.0), F.greatest(F.lit(1.0), conc)).alias("conc"))


def _upper(mean: Column, weight: Column, z: float) -> Column:
    return mean + z * F.sqrt(mean * (1 - mean) / (weight + 1))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, suffixes=SUFFIXES, threshold: float = THRESHOLD, z: float = BOUND_Z) -> DataFrame:
    """page_id, host, path, rule and verdict of each page. ``outcomes``: page_id, good (1 or 0)."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = outcomes.filter("good IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    domain, suffix = names(F.col("host"), suffixes)
    # all hosts, once: how many labelled pages, how many good ones
    hosts = split.join(labelled, "page_id", "left").groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    hosts = stored(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good"), "hosts")
    known = hosts.filter("n > 0")
    domains = stored(_rolled(known, "domain", "suffix"), "domains")
    suffixes_ = _rolled(domains, "suffix")
    world = _rolled(suffixes_.withColumn("world", F.lit(1)), "world").select("m", "conc").first()
    mean, conc = (world["m"], world["conc"]) if world else (0.5, 1.0)
    top = suffixes_.select("suffix", ((F.col("good") + mean * conc) / (F.col("n") + conc)).alias("s_mean"), F.col("conc").alias("s_conc"))
    mid = domains.join(top, "suffix").select("domain", ((F.col("good") + F.col("s_mean") * F.col("s_conc")) / (F.col("n") + F.col("s_conc"))).alias("d_mean"), F.col("conc").alias("d_conc"))
    x = hosts.join(mid, "domain", "left").join(top, "suffix", "left")
    weight = F.col("n") + F.col("d_conc")
    own = F.when(F.col("n") > 0, _upper((F.col("good") + F.col("d_mean") * F.col("d_conc")) / weight, weight, z))
    upper = F.coalesce(own, _upper(F.col("d_mean"), F.col("d_conc"), z), _upper(F.col("s_mean"), F.col("s_conc"), z), _upper(F.lit(mean), F.lit(conc), z))
    bounds = stored(x.select("host", upper.alias("upper")), "bounds")
    if bounds.count() <= MOST_BROADCAST:
        bounds = F.broadcast(bounds)
    judged = split.join(bounds, "host").withColumn("r", ruled(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("upper") < threshold, "block").otherwise("allow")).alias("verdict"))
