"""Headlines, HTML, publishers, rules and groups of news, on documents and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.fixed_values import CHEAP_ATTACH, COMMODITY_PROXIES, EVENT_CLASS_TEXT, EXCHANGE_TICKER, HIGH_VALUE, LAWYER_SPAM, MACRO_KEYWORDS, NOISE, PROMOTION_MATERIALITY, SCHEDULING
from tidewire.functions import text as T
from tidewire.operators import graph, grouping, rules, sequential, setjoin, verify
from tidewire.plans.catalogue import query
from tidewire.sources import tables
from tidewire.sources.tables import table

NORM = r"trim(regexp_replace(lower(regexp_replace(split_part(text, chr(10), 1), 'https?://\S+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "list_distinct([w FOR w IN string_split(h, ' ') IF length(w) > 2 AND w NOT IN ('" + "', '".join(T.STOPWORDS) + "')])"
HEAD = f"n AS (SELECT doc_id, lang, source, text, {NORM} AS h FROM documents)"


def headlines(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").select("doc_id", "lang", "source", "text")
    return d.withColumn("headline", T.first_line(F.col("text"))).withColumn("norm", T.normalise_headline(F.col("headline")))


@query(f"WITH {HEAD} SELECT doc_id, h AS norm, substr(sha1(h), 1, 16) AS hash FROM n")
def headline_norm_hash(spark: SparkSession, base: str) -> DataFrame:
    return headlines(spark, base).select("doc_id", "norm", T.headline_hash(F.col("headline")).alias("hash"))


@query(f"WITH {HEAD}, g AS (SELECT substr(sha1(h), 1, 16) AS hash, count(*) AS n, min(doc_id) AS keep FROM n GROUP BY 1) SELECT hash, n, keep FROM g WHERE n > 1")
def exact_duplicate_groups(spark: SparkSession, base: str) -> DataFrame:
    return headlines(spark, base).groupBy(T.headline_hash(F.col("headline")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keep")).filter("n > 1")


@query(f"""WITH {HEAD}, t AS (SELECT doc_id, {TOKENS} AS w FROM n),
b AS (SELECT item_id, {TOKENS} AS w FROM (SELECT item_id, {NORM} AS h FROM benchmark))
SELECT doc_id, item_id, round(len(list_intersect(t.w, b.w)) / len(list_distinct(list_concat(t.w, b.w))), 6) AS score FROM t, b WHERE len(t.w) > 0 AND len(b.w) > 0 AND len(list_intersect(t.w, b.w)) / len(list_distinct(list_concat(t.w, b.w))) >= 0.3""")
def headline_tokens_jaccard(spark: SparkSession, base: str) -> DataFrame:
    a = headlines(spark, base).select("doc_id", T.headline_tokens(F.col("headline")).alias("w"))
    b = table(spark, base, "benchmark").select("item_id", T.headline_tokens(T.first_line(F.col("text"))).alias("w"))
    return setjoin.set_join(a, b, "doc_id", "item_id", "w", 0.3).withColumn("score", F.round("score", 6))


WINDOWED = f"""WITH {HEAD}, x AS (SELECT doc_id, doc_id - doc_id % 5 * 0.5 AS at, ['T' || doc_id % 7, 'T' || doc_id % 11] AS t, CASE WHEN doc_id % 3 > 0 THEN [source] ELSE [] END AS s, [lang] AS g, ['m_a', 'earnings', NULL][CAST(doc_id % 3 AS INT) + 1] AS e, {TOKENS} AS w FROM n)"""


def _jaccard_sql(c: str) -> str:
    return f"CASE WHEN len(a.{c}) > 0 AND len(b.{c}) > 0 THEN len(list_intersect(a.{c}, b.{c})) / len(list_distinct(list_concat(a.{c}, b.{c}))) ELSE 0 END"


def _timed(spark: SparkSession, base: str) -> DataFrame:
    """Headlines with features by their id, half an hour to three hours apart."""
    i = F.col("doc_id")
    at = F.timestamp_micros((F.lit(1_700_006_400_000_000) + (i - i % 5 * 0.5) * 3_600_000_000).cast("long"))
    ticker = lambda n: F.concat(F.lit("T"), (i % n).cast("string"))
    event = F.element_at(F.array(F.lit("m_a"), F.lit("earnings"), F.lit(None).cast("string")), (i % 3).cast("int") + 1)
    return headlines(spark, base).select("doc_id", at.alias("at"), F.array(ticker(7), ticker(11)).alias("tickers"), F.when(i % 3 > 0, F.array("source")).alias("sectors"), F.array("lang").alias("regions"), event.alias("event_class"), T.headline_tokens(F.col("headline")).alias("tokens"), T.headline_hash(F.col("headline")).alias("hash"))


@query(f"""{WINDOWED}, p AS (SELECT b.doc_id, a.doc_id AS earlier, 0.4 * {_jaccard_sql("t")} + 0.2 * {_jaccard_sql("s")} + 0.1 * {_jaccard_sql("g")} + 0.1 * {_jaccard_sql("w")} + CASE WHEN a.e = b.e THEN 0.2 ELSE 0 END AS score
  FROM x a JOIN x b ON (a.at, a.doc_id) < (b.at, b.doc_id) AND b.at - a.at <= 72) SELECT doc_id, earlier, round(score, 6) AS score FROM p WHERE score >= 0.6 - 1e-9""")
def likeness_within_72h(spark: SparkSession, base: str) -> DataFrame:
    """Headlines with those of the last 72 hours that are like them by tickers, sectors, regions, words and event class."""
    return setjoin.windowed_likeness(_timed(spark, base), "doc_id", "at", 72, CHEAP_ATTACH).withColumn("score", F.round("score", 6))


@query(f"""{WINDOWED}, l AS (SELECT doc_id, lag(doc_id) OVER w AS earlier, x.at - lag(x.at) OVER w AS hours FROM x JOIN n USING (doc_id) WINDOW w AS (PARTITION BY sha1(h) ORDER BY x.at, doc_id))
SELECT doc_id, earlier, round(CAST(hours AS DOUBLE), 6) AS hours FROM l WHERE hours <= 48""")
def headline_repeats_48h(spark: SparkSession, base: str) -> DataFrame:
    """Headlines that say what one of the last 48 hours said, with the latest such."""
    return setjoin.same_within(_timed(spark, base), "doc_id", "at", "hash", 48).withColumn("hours", F.round("hours", 6))


@query(f"""WITH {HEAD}, t AS (SELECT doc_id, {TOKENS} AS w FROM n),
b AS (SELECT item_id, {TOKENS} AS w FROM (SELECT item_id, {NORM} AS h FROM benchmark))
SELECT doc_id, item_id, round(len(list_intersect(t.w, b.w)) / least(len(t.w), len(b.w)), 6) AS score FROM t, b WHERE len(t.w) > 0 AND len(b.w) > 0 AND len(list_intersect(t.w, b.w)) / least(len(t.w), len(b.w)) >= 0.55""")
def title_containment(spark: SparkSession, base: str) -> DataFrame:
    a = headlines(spark, base).select("doc_id", T.headline_tokens(F.col("headline")).alias("w"))
    b = table(spark, base, "benchmark").select("item_id", T.headline_tokens(T.first_line(F.col("text"))).alias("w"))
    return setjoin.set_join(a, b, "doc_id", "item_id", "w", 0.55, "containment").withColumn("score", F.round("score", 6))


ALIASES = [("der und", "DE1"), ("la le", "FR1"), ("que los", "ES1"), ("of the", "EN1"), ("with", "EN2"), ("dans", "FR2")]


@query(f"""WITH {HEAD}, a(alias, symbol) AS (VALUES {', '.join(str(x) for x in ALIASES)}), f AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(text, 'https?://\\S+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS t FROM n)
SELECT DISTINCT doc_id, symbol FROM f, a WHERE contains(' ' || t || ' ', ' ' || alias || ' ')""")
def alias_hits(spark: SparkSession, base: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "alias string, symbol string")
    return rules.alias_hits(table(spark, base, "documents"), "doc_id", F.col("text"), aliases, "alias", "symbol", 2)


SITES = [("example.com", "Example", "tier1", "news", "example", "neutral"), ("example.org", "Example Org", "wire", "pr_wire", "example", "neutral"), ("thth.example.net", "Thth", "trade", "news", "thth", "state_media")]


@query(f"""WITH s(suffix, publisher, tier, kind, independence, stance) AS (VALUES {', '.join(str(x) for x in SITES)}),
h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^(?:www\\.|mobile\\.|m\\.)', '') AS host FROM pages),
j AS (SELECT h.*, s.publisher, s.tier, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC) AS r FROM h LEFT JOIN s ON host = suffix OR ends_with(host, '.' || suffix))
SELECT page_id, host, coalesce(publisher, host) AS publisher, coalesce(tier, 'other') AS tier FROM j WHERE r = 1""")
def publisher_host(spark: SparkSession, base: str) -> DataFrame:
    return rules.with_publisher(table(spark, base, "pages").select("page_id", "url"), "url", SITES).select("page_id", "host", "publisher", "tier")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query()
def html_unescaped(spark: SparkSession, base: str) -> DataFrame:
    """Tags out and entities resolved; SQL has no table of entities."""
    return table(spark, base, "pages").select("page_id", T.unescape(T.strip_tags(F.col("html"))).alias("text"))


NAMED = """(?:name|property)\\s*=\\s*["'](?:og:description|twitter:description|description)["']"""
CONTENT = """content\\s*=\\s*["']([^"']*)["']"""
META_SQL = f"(?i)<meta\\s+{NAMED}\\s+{CONTENT}".replace("'", "''"), f"(?i)<meta\\s+{CONTENT}\\s+{NAMED}".replace("'", "''")


@query(f"""WITH m AS (SELECT page_id, CASE WHEN regexp_matches(html, '{META_SQL[0]}') THEN regexp_extract(html, '{META_SQL[0]}', 1) ELSE regexp_extract(html, '{META_SQL[1]}', 1) END AS d FROM pages)
SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(d, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')), '') AS description FROM m""")
def meta_description(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pages").select("page_id", tables.meta_description().alias("description"))


# ------------------------------------------------------------------ rules: a phrase by the id stands before the text, which is invented

PHRASES = [
    "Acme reports second quarter results", "Fed announces rate cut", "Globex agrees to acquire Initech", "Umbrella raises guidance", "SEC charges broker", "Hooli to present at tech conference", "Quiet day in the market",
    "Acme to report fourth quarter earnings", "Lead plaintiff sought by investors", "Stark prices senior notes", "Wayne posts revenue up", "GDP rose", "Board names new chief",
]
PHRASE_SQL = "[" + ", ".join(f"'{p}'" for p in PHRASES) + f"][CAST(doc_id % {len(PHRASES)} AS INT) + 1]"


def _q(p: str) -> str:
    return "'(?i)" + p.replace("'", "''").replace("(?=", "(?:") + "'"


def _score_sql() -> str:
    """A row for each pattern a text has, added up a text."""
    events = ", ".join(f"({k}, {w}, '{label}')" for k, (_, w, label) in enumerate(HIGH_VALUE))
    in_full = "[" + ", ".join(f"regexp_matches(f, {_q(p)})" for p, _, _ in HIGH_VALUE) + "]"
    in_head = "[" + ", ".join(f"regexp_matches(h, {_q(p)})" for p, _, _ in HIGH_VALUE) + "]"
    noise = "[" + ", ".join(f"CASE WHEN regexp_matches(h, {_q(p)}) OR regexp_matches(b, {_q(p)}) THEN '{label}' END" for p, label in NOISE) + "]"
    return f"""WITH e(k, w, label) AS (VALUES {events}), d AS (SELECT doc_id, {PHRASE_SQL} AS h, substr(text, 1, 600) AS b FROM documents),
    t AS (SELECT doc_id, regexp_matches(h, {_q(LAWYER_SPAM)}) AS spam, regexp_matches(h, {_q(SCHEDULING)}) AS sched, {in_full} AS fs, {in_head} AS hs, {noise} AS ns FROM (SELECT *, concat(h, '  ||  ', b) AS f FROM d)),
    x AS (SELECT doc_id, label, w + CASE WHEN hs[k + 1] THEN 5 ELSE 0 END AS w FROM t, e WHERE fs[k + 1] AND NOT (sched AND label = 'earnings')),
    n AS (SELECT doc_id, unnest(ns) AS label FROM t UNION ALL SELECT doc_id, 'earnings_schedule' FROM t WHERE sched),
    l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM x UNION ALL SELECT doc_id, label FROM n WHERE label IS NOT NULL) GROUP BY doc_id),
    s AS (SELECT doc_id, sum(w) AS total FROM x GROUP BY doc_id)
    SELECT t.doc_id, CASE WHEN spam THEN 0 WHEN total > 0 THEN least(100, total) WHEN labels IS NOT NULL THEN 0 ELSE 15 END::INT AS score,
      CASE WHEN spam THEN 'lawyer_spam' ELSE coalesce(labels, '') END AS labels FROM t LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)"""


def _phrase() -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int") + 1)


@query(_score_sql())
def materiality_score(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").select("doc_id", F.substring("text", 1, 600).alias("text"))
    tasks = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < tasks:  # a file or two: the patterns cost far more than a shuffle of what they read
        d = d.repartition(tasks)
    d = rules.with_materiality(d, _phrase(), F.col("text"))
    return d.select("doc_id", "materiality.score", F.array_join("materiality.labels", ",").alias("labels"))


INSTRUMENTS = [
    ("GBX", "Globex", ["Globex Holdings", "GLBX"], "equity"), ("INI", "Initech", ["parsons"], "equity"), ("UMB", "umbrella", [], "equity"), ("SEC", None, [], "equity"), ("STK", "Stark", ["Stark prices"], "equity"),
    ("GC=F", "Revenue", ["quarter results"], "commodity"), ("PSN", "market", ["in the market", "to"], "equity"), ("W", "GDP", ["GDP rose"], "equity"), ("HLI", "guidance", ["Fed", "S&P 500"], "equity"),
]
TAG_NAMES = "(VALUES ('GBX', 'globex', FALSE), ('GBX', 'globex holdings', FALSE), ('GBX', 'GBX', TRUE), ('GBX', 'GLBX', TRUE), ('INI', 'INI', TRUE), ('INI', 'initech', FALSE), ('UMB', 'UMB', TRUE), ('UMB', 'umbrella', FALSE), ('SEC', 'SEC', TRUE), ('STK', 'STK', TRUE), ('STK', 'stark prices', FALSE), ('GC=F', 'GC=F', TRUE), ('GC=F', 'quarter results', FALSE), ('PSN', 'market', FALSE), ('PSN', 'in the market', FALSE), ('W', 'GDP', TRUE), ('W', 'gdp rose', FALSE), ('HLI', 'HLI', TRUE), ('HLI', 'guidance', FALSE), ('HLI', 's&p 500', FALSE))"


@query(f"""WITH a(symbol, alias, cased) AS {TAG_NAMES}, d AS (SELECT doc_id, {PHRASE_SQL} || '  ||  ' || coalesce(substr(text, 1, 400), '') AS f FROM documents),
m AS (SELECT doc_id, symbol FROM d, a WHERE CASE WHEN cased THEN regexp_matches(f, '(^|[^A-Za-z0-9])' || regexp_escape(alias) || '([^A-Za-z0-9]|$)') ELSE regexp_matches(lower(f), '(^|[^a-z0-9])' || regexp_escape(alias) || '([^a-z0-9]|$)') END
  UNION SELECT doc_id, unnest(CASE {" ".join(f"WHEN k = {k} THEN {symbols}" for k, (_, symbols) in enumerate(COMMODITY_PROXIES))} END) FROM d, (VALUES {", ".join(f"({k}, {_q(p)})" for k, (p, _) in enumerate(COMMODITY_PROXIES))}) c(k, p) WHERE regexp_matches(f, p)),
k AS (SELECT doc_id, trim(kw) AS kw FROM d, (VALUES {", ".join("('" + w.replace("'", "''") + "')" for w in MACRO_KEYWORDS)}) w(kw) WHERE contains(lower(f), kw)),
x AS (SELECT doc_id, list_distinct(regexp_extract_all(f, '{EXCHANGE_TICKER}', 1)) AS ex FROM d)
SELECT d.doc_id, array_to_string(list_sort(coalesce(ex, [])), ',') AS exchange_tickers, coalesce((SELECT string_agg(DISTINCT symbol, ',' ORDER BY symbol) FROM m WHERE m.doc_id = d.doc_id), '') AS symbols,
  coalesce((SELECT string_agg(DISTINCT kw, ',' ORDER BY kw) FROM k WHERE k.doc_id = d.doc_id), '') AS macro_keywords FROM d JOIN x USING (doc_id)""")
def tag_gate(spark: SparkSession, base: str) -> DataFrame:
    index = rules.alias_index(spark.createDataFrame(INSTRUMENTS, "symbol string, short string, aliases array<string>, asset_class string"))
    out = rules.tagged(table(spark, base, "documents").select("doc_id", "text"), "doc_id", _phrase(), F.col("text"), index)
    return out.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("exchange_tickers", "symbols", "macro_keywords")])


@query(f"WITH d AS (SELECT doc_id, {PHRASE_SQL} AS h, {PHRASE_SQL} || chr(10) || text AS f FROM documents) SELECT doc_id, coalesce({', '.join(f'CASE WHEN regexp_matches(h, {_q(p)}) THEN {chr(39)}{k}{chr(39)} END' for p, k in EVENT_CLASS_TEXT)}, {', '.join(f'CASE WHEN regexp_matches(f, {_q(p)}) THEN {chr(39)}{k}{chr(39)} END' for p, k in EVENT_CLASS_TEXT)}) AS event_class FROM d")
def event_class(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", T.event_class_of_text(_phrase(), F.col("text")).alias("event_class"))


def _groups(spark: SparkSession, base: str) -> DataFrame:
    """Groups with what the routing rules look at, all of it arithmetic on the id."""
    d = table(spark, base, "documents").select("doc_id")
    i = F.col("doc_id")
    cls = F.element_at(F.array(F.lit("fed_action"), F.lit("regulatory"), F.lit("m_a"), F.lit("earnings"), F.lit(None).cast("string")), (i % 5).cast("int") + 1)
    c = {
        "max_materiality": (i * 7 % 101), "pubs": i % 4, "tier1": i % 6 == 0, "institutional": i % 11 == 0, "tickers": F.array(F.element_at(F.array(F.lit("AAPL"), F.lit("ZZZ"), F.lit("QQQ9")), (i % 3).cast("int") + 1)),
        "sectors": F.array(F.element_at(F.array(F.lit("energy.oil_gas"), F.lit("macro.fx")), (i % 2).cast("int") + 1)), "regions": F.array(F.when((i % 7 == 0) | (i % 11 == 0), "japan").otherwise("europe")), "event_class": cls, "press_wire": i % 13 == 0, "non_pr": i % 5 != 1, "min_age_h": F.when(i % 9 > 0, (i * 13 % 200).cast("double")), "macro": i % 10 == 0,
    }
    none = F.array(F.lit("QQQ9"))
    return d.select("doc_id", (i * 7 % 101).alias("mat"), (i % 4).alias("pubs"), (i % 2).alias("sector"), rules.routed(c, none, F.array(F.lit("energy.oil_gas")), F.array(F.lit("japan"))).alias("r")).select("doc_id", "mat", "pubs", "sector", "r.route", "r.reason")


ROUTES = """g AS (SELECT doc_id, doc_id * 7 % 101 AS mat, doc_id % 4 AS pubs, doc_id % 6 = 0 AS t1, doc_id % 11 = 0 AS inst, doc_id % 3 AS tick, doc_id % 2 AS sector, doc_id % 7 = 0 OR doc_id % 11 = 0 AS japan, ['fed_action', 'regulatory', 'm_a', 'earnings', NULL][CAST(doc_id % 5 AS INT) + 1] AS cls,
  doc_id % 13 = 0 AS pw, doc_id % 5 <> 1 AS np, CASE WHEN doc_id % 9 > 0 THEN doc_id * 13 % 200 END AS age, doc_id % 10 = 0 AS macro FROM documents),
x AS (SELECT *, age IS NULL OR age <= 48 AS st, age IS NULL OR age <= 168 AS re, t1 OR inst OR pubs >= 2 AS corr FROM g),
d AS (SELECT doc_id, mat, pubs, sector, CASE WHEN mat = 0 AND tick <> 2 AND NOT macro AND NOT t1 AND NOT inst THEN 'floor' WHEN inst AND cls IN ('fed_action', 'macro_print') AND mat >= 50 AND st THEN 'R0' WHEN inst AND cls = 'regulatory' AND mat >= 70 AND re THEN 'R0b'
  WHEN pubs >= 3 AND t1 AND re THEN 'R0c' WHEN mat >= 30 AND t1 AND re THEN 'R1' WHEN pubs >= 3 AND mat >= 25 AND re THEN 'R2' WHEN pubs >= 2 AND t1 AND mat >= 25 AND re THEN 'R2b' WHEN tick = 2 AND mat >= 25 AND re THEN 'R3'
  WHEN cls IN ('fed_action', 'macro_print', 'm_a', 'regulatory') AND mat >= 35 AND corr AND st THEN 'R4' WHEN sector = 0 AND mat >= 25 AND corr AND re THEN 'R5' WHEN japan AND mat >= 25 AND corr AND re THEN 'R6'
  WHEN tick = 0 AND cls IS NOT NULL AND mat >= 45 AND np AND NOT pw AND st THEN 'R7' WHEN cls IN ('fed_action', 'macro_print') AND mat >= 55 AND np AND NOT pw AND st THEN 'R8' ELSE 'default' END AS reason FROM x),
r AS (SELECT *, CASE reason WHEN 'floor' THEN 'discard' WHEN 'default' THEN 'firehose_store' ELSE 'sharp_promote' END AS route FROM d)"""


@query(f"WITH {ROUTES} SELECT doc_id, mat, pubs, sector, route, reason FROM r")
def route_decisions(spark: SparkSession, base: str) -> DataFrame:
    return _groups(spark, base)


@query(f"WITH {ROUTES} SELECT 'all' AS stage, count(*) AS n FROM r UNION ALL SELECT 'route:' || route, count(*) FROM r GROUP BY route UNION ALL SELECT 'reason:' || reason, count(*) FROM r WHERE route = 'sharp_promote' GROUP BY reason")
def funnel_counts(spark: SparkSession, base: str) -> DataFrame:
    return rules.funnel(_groups(spark, base), "route", "reason")


@query(f"""WITH {ROUTES}, v AS (SELECT doc_id % 7 AS run, route, CASE WHEN route = 'sharp_promote' THEN ['admitted', 'admitted', 'budget', 'diversity'][CAST(doc_id % 4 AS INT) + 1] END AS verdict, doc_id % 5 > 0 AS made, doc_id % 8 AS members FROM r),
c AS (SELECT run, count(*) AS evaluated, count(*) FILTER (route = 'discard') AS discard, count(*) FILTER (route = 'firehose_store') AS firehose_store, count(*) FILTER (route = 'sharp_promote') AS sharp_promote, count(*) FILTER (verdict = 'admitted') AS admitted, count(*) FILTER (verdict = 'budget') AS overflow_budget,
  count(*) FILTER (verdict = 'diversity') AS overflow_diversity, count(*) FILTER (verdict = 'admitted' AND made) AS made, count(*) FILTER (verdict = 'admitted' AND NOT made) AS rejected, count(*) FILTER (verdict = 'admitted' AND members <= 1) AS size_1, count(*) FILTER (verdict = 'admitted' AND members = 2) AS size_2,
  count(*) FILTER (verdict = 'admitted' AND members BETWEEN 3 AND 5) AS size_3_5, count(*) FILTER (verdict = 'admitted' AND members >= 6) AS size_6 FROM v GROUP BY run)
SELECT *, CASE WHEN admitted > 0 THEN round(rejected / admitted, 3) ELSE 0 END AS reject_rate, CASE WHEN sharp_promote > 0 THEN round(made / sharp_promote, 3) ELSE 0 END AS promote_yield FROM c""")
def funnel_yields(spark: SparkSession, base: str) -> DataFrame:
    """The funnel of seven runs: routes, overflow, what was made of those admitted, and the yields."""
    i, g = F.col("doc_id"), _groups(spark, base)
    verdict = F.when(F.col("route") == "sharp_promote", F.element_at(F.array(*[F.lit(x) for x in ("admitted", "admitted", "budget", "diversity")]), (i % 4).cast("int") + 1))
    return rules.funnel_report(g.withColumns({"run": i % 7, "verdict": verdict, "made": i % 5 > 0, "members": i % 8}), ["run"], "route", "verdict", "made", "members")


@query("SELECT 'S' || o_custkey % 40 AS symbol, count(*) AS uses FROM orders WHERE 'S' || o_custkey % 40 NOT IN (SELECT 'S' || n_nationkey FROM nation) GROUP BY 1")
def uncovered_symbols(spark: SparkSession, base: str) -> DataFrame:
    """Symbols that orders name and the registry, a nation each, lacks."""
    name = lambda c: F.concat(F.lit("S"), c.cast("string")).alias("symbol")
    return tables.uncovered(table(spark, base, "orders").select(name(F.col("o_custkey") % 40)), "symbol", table(spark, base, "nation").select(name(F.col("n_nationkey"))), "symbol")


@query()
def diversity_admit(spark: SparkSession, base: str) -> DataFrame:
    """Of the promoted groups of a run (one a parity), in the order of their rules, those that the budget and the shares let in."""
    g = _groups(spark, base).filter("route = 'sharp_promote'").withColumn("run", F.col("doc_id") % 2).withColumn("region", F.col("pubs"))
    order = [rules.reason_rank(F.col("reason")), F.desc("pubs"), F.desc("mat"), F.col("doc_id")]
    return sequential.diversity_admit(g.withColumn("exempt", F.col("reason").isin("R0", "R0b")), "run", "doc_id", order, "sector", "region", "exempt")


# ------------------------------------------------------------------ groups of news


@query(f"""WITH RECURSIVE {HEAD}, t AS (SELECT doc_id, h, {TOKENS} AS w FROM n), l AS (SELECT h, min(doc_id) AS lead, any_value(w) AS w FROM t WHERE h <> '' GROUP BY h),
e AS (SELECT a.lead AS a, b.lead AS b FROM l a JOIN l b ON a.lead <> b.lead WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.6 * len(list_distinct(list_concat(a.w, b.w)))),
r(node, root) AS (SELECT lead, lead FROM l UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), g AS (SELECT node, min(root) AS grp FROM r GROUP BY node)
SELECT t.doc_id, coalesce(grp, t.doc_id) AS grp FROM t LEFT JOIN l ON l.h = t.h LEFT JOIN g ON g.node = l.lead""")
def cluster_batch(spark: SparkSession, base: str) -> DataFrame:
    """Documents whose headlines are the same or share 0.6 of their words, joined into groups: the least id of each stands for it.

    Equal headlines are folded before the join, so that many copies are one row in it. A document without a headline is a group of its own.
    """
    every = headlines(spark, base).select("doc_id", "norm", T.headline_tokens(F.col("headline")).alias("w"))
    h = every.filter("norm <> ''")
    kept = h.groupBy("norm").agg(F.min("doc_id").alias("lead"), F.first("w").alias("w"))
    a, b = kept.select(F.col("lead").alias("a"), "w"), kept.select(F.col("lead").alias("b"), "w")
    near = setjoin.set_join(a, b, "a", "b", "w", 0.6, ascending=True).select("a", "b")
    found = graph.components(near)
    own = h.join(kept.select("norm", "lead"), "norm").join(found, F.col("lead") == F.col("node"), "left")
    alone = every.filter("norm = ''").select("doc_id", F.col("doc_id").alias("grp"))
    return own.select("doc_id", F.coalesce("component", "lead").alias("grp")).unionByName(alone)


@query()
def cluster_sequential(spark: SparkSession, base: str) -> DataFrame:
    """Documents in the order of their id, an hour apart, joined online to groups, across sources."""
    return grouping.online_groups(_news(spark, base), "doc_id", "published_at", "seen_at")[0]


def _news(spark: SparkSession, base: str) -> DataFrame:
    h = headlines(spark, base)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3600)
    none = F.array().cast("array<string>")
    return h.select("doc_id", at.alias("published_at"), at.alias("seen_at"), F.array("lang").alias("tickers"), F.array("source").alias("sectors"), none.alias("regions"), T.headline_tokens(F.col("headline")).alias("tokens"), F.col("lang").alias("event_class"), T.headline_hash(F.col("headline")).alias("hash"))


@query()
def cluster_with_vectors(spark: SparkSession, base: str) -> DataFrame:
    """As ``cluster_sequential``, with the pass over vectors: documents whose materiality makes them candidates bring the vector of the same id."""
    vectors = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    texts = table(spark, base, "documents").select("doc_id", _phrase().alias("head"), F.substring("text", 1, rules.EXCERPT_CHARS).alias("body"))
    scored = rules.with_materiality(texts.join(vectors.select("doc_id"), "doc_id", "left_semi"), F.col("head"), F.col("body"))  # only a document with a vector can bring one
    candidates = scored.filter(F.col("materiality.score") >= PROMOTION_MATERIALITY).select("doc_id")
    vectors = vectors.join(candidates, "doc_id")
    news = _news(spark, base).withColumns({"event_class": F.lit(None).cast("string"), "sectors": F.array().cast("array<string>")})
    return grouping.online_groups(news.join(vectors, "doc_id", "left"), "doc_id", "published_at", "seen_at")[0]


def _stories(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, base, "documents").select((F.col("doc_id") / 3).cast("bigint").alias("story"), F.col("doc_id").cast("string").alias("news_id"), F.col("text").alias("body"))
    lead = d.groupBy("story").agg(F.min_by("news_id", F.col("news_id").cast("bigint")).alias("id"), F.min_by("body", F.col("news_id").cast("bigint")).alias("body"))
    cite = lambda text, ids: F.struct(text.alias("text"), ids.alias("source_doc_ids"))
    ids, other = F.array("id"), F.array(F.lit("-1"))
    quote = lambda text, speaker, x: F.struct(text.alias("text"), speaker.alias("speaker"), x.alias("source_doc_ids"))
    start, odd = F.substring("body", 1, 60), F.col("story") % 5 == 0
    payload = lead.select(
        "story", F.array(cite(F.lit("what happened"), F.when(odd, other).otherwise(ids))).alias("overview"), F.array(cite(F.lit("it grew"), ids)).alias("claims"),
        F.array(quote(start, F.lit("someone"), ids), quote(F.concat(F.lit("never said: "), start), F.lit("someone"), ids)).alias("quotes"),
        F.array(F.struct(F.when(F.col("story") % 7 == 0, "not a symbol").otherwise("AAPL").alias("symbol"), F.col("id").alias("source_doc_id"), F.substring("body", 1, 5).alias("evidence_span"))).alias("tickers"),
    )
    return payload, d


@query()
def verify_payload(spark: SparkSession, base: str) -> DataFrame:
    payload, members = _stories(spark, base)
    out = verify.verify_payload(payload, members, "story")
    return out.select("story", "ok", F.array_join("errors", "; ").alias("errors"), F.array_join(F.col("quote_scrub_indices").cast("array<string>"), ",").alias("scrub"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract(trim(text), '^(.*?[.!?])(\s|$)', 1) AS s FROM documents)
SELECT doc_id, 1 AS position, 'no_source' AS issue FROM d UNION ALL SELECT doc_id, 0, 'no_text' FROM d WHERE trim(coalesce(s, '')) = '' UNION ALL SELECT doc_id, 0, 'no_number' FROM d WHERE NOT coalesce(regexp_matches(s, '\d+(?:\.\d+)?\s?(?:%|bps|bn|m|k|x)?\b'), FALSE)
UNION ALL SELECT doc_id, 0, 'unknown_source' FROM d WHERE doc_id % 60 NOT IN (SELECT item_id FROM benchmark)""")
def brief_provenance(spark: SparkSession, base: str) -> DataFrame:
    """Sentences of documents as items of a brief whose sources are benchmark items."""
    d = table(spark, base, "documents").select("doc_id", F.array(F.struct(T.first_sentence(F.col("text")).alias("text"), F.array(F.col("doc_id") % 60).alias("source_ids")), F.struct(F.lit("up 3%").alias("text"), F.array().cast("array<bigint>").alias("source_ids"))).alias("items"))
    return verify.provenance(d, "doc_id", "items", table(spark, base, "benchmark"), "item_id")
