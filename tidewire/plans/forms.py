"""Forms of texts, values and times, summaries of groups, and the smaller rules, on documents, events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.fixed_values import EVENT_CLASS_MAP, EVENT_CLASS_ORDER, PR_WIRE_CAP, REASON_ORDER, TIER1_MACRO, TIER1_MACRO_FLOOR
from tidewire.functions import text as T
from tidewire.functions import values
from tidewire.operators import health, indicators, relational, rules, scoring, sequential, usage
from tidewire.plans.catalogue import query
from tidewire.plans.texts import PHRASE_SQL, _phrase, _q
from tidewire.sources import tables
from tidewire.sources.tables import table

CLASSES = ["fda", "earnings", "odd label", "rates", None]
KINDS, TIERS = ["pr_wire", "news", "institutional", "news"], ["wire", "tier1", "trade", "other", "other"]


def _pick(names: list, of: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), of.cast("int") + 1)


def _list(names: list) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in names) + "]"


GROUPS_SQL = f"""WITH m AS (SELECT event_id AS i, user_id AS g, event_id * 13 % 101 AS mat, {_list(KINDS)}[CAST(event_id % 4 AS INT) + 1] AS kind, CASE WHEN event_id % 7 = 0 THEN 'state_media' ELSE 'neutral' END AS stance, 'p' || event_id % 5 AS ind, {_list(TIERS)}[CAST(event_id % 5 AS INT) + 1] AS tier,
  CASE WHEN event_id % 9 = 0 THEN [] ELSE ['T' || event_id % 3, 'T' || event_id % 4] END AS tickers, {_list(CLASSES)}[CAST(event_id % 5 AS INT) + 1] AS cls, coalesce(CASE WHEN event_id % 3 > 0 THEN ts END, ts + INTERVAL 1 HOUR) AS seen FROM events),
c AS (SELECT g, cls, count(*) AS n FROM m WHERE cls IS NOT NULL GROUP BY g, cls QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, cls) = 1)
SELECT m.g, CASE WHEN bool_and(kind = 'pr_wire') THEN least(max(mat), {PR_WIRE_CAP}) ELSE max(mat) END AS max_materiality, count(*) AS members, count(DISTINCT CASE WHEN stance <> 'state_media' THEN ind END) AS independent_pub_count, array_to_string(list_sort(list_distinct(flatten(list(tickers)))), ',') AS tickers,
  bool_or(tier IN ('wire', 'tier1')) AS tier1, bool_or(kind = 'institutional') AS institutional, bool_or(kind = 'pr_wire') AS press_wire, bool_or(kind = 'news') AS non_pr, min(seen) AS first_seen_at, max(seen) AS last_seen_at, any_value(c.cls) AS event_class FROM m LEFT JOIN c ON c.g = m.g GROUP BY m.g"""


@query(GROUPS_SQL)
def group_summaries(spark: SparkSession, base: str) -> DataFrame:
    return _shown(rules.group_summary(members_of_groups(table(spark, base, "events")), "g"))


def members_of_groups(events: DataFrame) -> DataFrame:
    """Events as members of a group a user."""
    i = F.col("event_id")
    none, tick = F.array().cast("array<string>"), lambda n: F.concat(F.lit("T"), (i % n).cast("string"))
    return events.select(
        "event_id", F.col("user_id").alias("g"), (i * 13 % 101).cast("int").alias("materiality_score"), _pick(KINDS, i % 4).alias("kind"), F.when(i % 7 == 0, "state_media").otherwise("neutral").alias("stance"), F.concat(F.lit("p"), (i % 5).cast("string")).alias("independence"), _pick(TIERS, i % 5).alias("tier"),
        F.when(i % 9 == 0, none).otherwise(F.array(tick(3), tick(4))).alias("tickers"), none.alias("sectors"), none.alias("regions"), _pick(CLASSES, i % 5).alias("event_class"), F.when(i % 3 > 0, F.col("ts")).alias("published_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
    )


def _shown(s: DataFrame) -> DataFrame:
    return s.select("g", "max_materiality", "members", "independent_pub_count", F.array_join("tickers", ",").alias("tickers"), F.col("has_tier1_primary").alias("tier1"), F.col("has_institutional_primary").alias("institutional"), F.col("has_press_wire_primary").alias("press_wire"), F.col("has_non_pr_news_primary").alias("non_pr"), "first_seen_at", "last_seen_at", "event_class")


MAP_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in EVENT_CLASS_MAP.items()) + "}"


@query(f"""WITH d AS (SELECT doc_id, text, {PHRASE_SQL} AS h, [['FDA', 'earnings'], ['zeta', 'Alpha'], [NULL, ''], ['tariff', 'rates', 'x'], []][CAST(doc_id % 5 AS INT) + 1] AS labels FROM documents),
k AS (SELECT doc_id, list_distinct([coalesce({MAP_SQL}[lower(x)], lower(x)) FOR x IN labels IF x IS NOT NULL AND x <> '']) AS mapped FROM d)
SELECT d.doc_id, coalesce([x FOR x IN {_list(EVENT_CLASS_ORDER)} IF list_contains(mapped, x)][1], list_min(mapped)) AS label_class, regexp_replace(regexp_replace(lower(h), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN length(text) > 280 THEN rtrim(substr(text, 1, 277), ' ') || '...' ELSE text END AS snippet, contains(' ' || lower(h) || ' ', ' rate ') AS has_rate, nullif(regexp_extract(trim(text, ' '), '^(.*?[.!?])(\\s|$)', 1), '') AS sentence FROM d JOIN k USING (doc_id)""")
def text_forms(spark: SparkSession, base: str) -> DataFrame:
    labels = F.element_at(F.array(*[F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (["FDA", "earnings"], ["zeta", "Alpha"], [None, ""], ["tariff", "rates", "x"], [])]), (F.col("doc_id") % 5).cast("int") + 1)
    d = table(spark, base, "documents")
    return d.select("doc_id", T.event_class_of_labels(labels).alias("label_class"), T.slug(_phrase()).alias("slug"), T.snippet(F.col("text")).alias("snippet"), T.phrase_in(F.lower(_phrase()), "rate").alias("has_rate"), F.nullif(T.first_sentence(F.col("text")), F.lit("")).alias("sentence"))


LISTS = ['["b", " ", "a"]', "not json", '["z"]', "[]", None]
TIMES = ["2024-01-10T05:00:00Z", "2024-01-10T05:00:00+02:00", " 2024-01-10 05:00:00 ", "soon", None]


@query(f"""WITH e AS (SELECT event_id, {_list(LISTS)}[CAST(event_id % 5 AS INT) + 1] AS j, ['2024-01-10 05:00:00', '2024-01-10 03:00:00', '2024-01-10 05:00:00', NULL, NULL][CAST(event_id % 5 AS INT) + 1]::TIMESTAMP AS t, ['45', '3', '500', '-2', 'x'][CAST(event_id % 5 AS INT) + 1] AS days, ts FROM events)
SELECT event_id, array_to_string([x FOR x IN CASE event_id % 5 WHEN 0 THEN ['b', 'a'] WHEN 2 THEN ['z'] ELSE [] END], '|') AS items, CASE event_id % 5 WHEN 0 THEN '["a","b"]' WHEN 2 THEN '["z"]' ELSE '[]' END AS sorted,
  CASE WHEN t IS NOT NULL THEN round(greatest(0, epoch(ts) - epoch(t)) / 3600.0, 6) END AS age, CASE event_id % 5 WHEN 0 THEN 45 WHEN 1 THEN 10 WHEN 2 THEN 120 ELSE 45 END AS horizon FROM e""")
def value_forms(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("event_id") % 5
    items = values.text_list(_pick(LISTS, i))
    age = values.age_hours(values.parse_time(_pick(TIMES, i)), F.col("ts"))
    return table(spark, base, "events").select("event_id", F.array_join(items, "|").alias("items"), values.sorted_json(items).alias("sorted"), F.round(age, 6).alias("age"), values.clamp_horizon(_pick(["45", "3", "500", "-2", "x"], i)).alias("horizon"))


@query(f"""WITH d AS (SELECT doc_id, doc_id * 17 % 101 AS s, {_list([*KINDS[:3], None])}[CAST(doc_id % 4 AS INT) + 1] AS k, {_list(TIERS)}[CAST(doc_id % 5 AS INT) + 1] AS t, {PHRASE_SQL} AS h FROM documents),
c AS (SELECT *, CASE WHEN k = 'pr_wire' THEN least(s, {PR_WIRE_CAP}) ELSE s END AS capped FROM d), r AS (SELECT *, t = 'tier1' AND regexp_matches(h, {_q(TIER1_MACRO)}) AND capped < {TIER1_MACRO_FLOOR} AS up FROM c)
SELECT doc_id, CAST(CASE WHEN up THEN {TIER1_MACRO_FLOOR} ELSE capped END AS INT) AS score, CASE WHEN up THEN 'm_a,tier1_macro_commentary' ELSE 'm_a' END AS labels FROM r""")
def publisher_adjusted(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("doc_id")
    m = rules.adjusted((i * 17 % 101).cast("int"), F.array(F.lit("m_a")), _phrase(), _pick([*KINDS[:3], None], i % 4), _pick(TIERS, i % 5))
    return table(spark, base, "documents").select(i, m.alias("m")).select("doc_id", "m.score", F.array_join("m.labels", ",").alias("labels"))


@query(f"SELECT event_id, CAST(coalesce(list_position({_list(REASON_ORDER)}, {_list([*REASON_ORDER, 'floor'])}[CAST(event_id % 13 AS INT) + 1]) - 1, 12) AS INT) AS rank FROM events")
def reason_ranks(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("event_id") % 13
    return table(spark, base, "events").select("event_id", rules.reason_rank(F.when(i == 12, "floor").otherwise(F.concat(_pick([*REASON_ORDER, "floor"], i), F.lit(":mat")))).alias("rank"))


@query("SELECT c.c_custkey AS symbol, coalesce(t.c_custkey, c.c_custkey) AS canonical FROM customer c LEFT JOIN customer t ON t.c_custkey = CASE WHEN c.c_custkey % 4 = 0 THEN c.c_custkey / 4 END AND t.c_acctbal > 0")
def canonical_symbols(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "customer").select(F.col("c_custkey").alias("symbol"), F.when(F.col("c_custkey") % 4 == 0, (F.col("c_custkey") / 4).cast("bigint")).alias("pointer"), (F.col("c_acctbal") > 0).alias("active"))
    return rules.canonical(c, "symbol", "pointer", "active")


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN NULL ELSE [('tool-a', 'c' || turn % 4), ('tool-b', 'c' || conv_id % 3), ('text', 'x'), ('tool-c', NULL)] END AS p FROM conversations),
n AS (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN turn % 4 = conv_id % 3 THEN 1 ELSE 2 END AS k FROM m)
SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN k ELSE 0 END)::BIGINT AS tool_steps, arg_max(k, turn) FILTER (role = 'assistant') AS last_tool_steps FROM n GROUP BY conv_id""")
def tool_steps(spark: SparkSession, base: str) -> DataFrame:
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.cast("string").alias("toolCallId"))
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    parts = F.when(F.col("turn") % 3 != 2, F.array(part("tool-a", name(F.col("turn") % 4)), part("tool-b", name(F.col("conv_id") % 3)), part("text", F.lit("x")), part("tool-c", F.lit(None))))
    return usage.tool_steps(table(spark, base, "conversations").withColumn("parts", parts), "conv_id", "turn", "role", "parts", "turn").withColumn("tool_steps", F.col("tool_steps").cast("long"))


@query("SELECT event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latest_of_each_metric(spark: SparkSession, base: str) -> DataFrame:
    return health.latest_by_name(table(spark, base, "events").filter("value IS NOT NULL"), "event_type", "event_id", "value")


@query("""WITH t AS (SELECT max(ts) AS now FROM events), x AS (SELECT event_id, ['candidate', 'active', 'rejected'][CAST(event_id % 3 AS INT) + 1] AS s, event_id % 4 AS links, epoch(now - ts) / 86400 AS age FROM events, t)
SELECT event_id, CASE WHEN s <> 'candidate' THEN s WHEN links >= 1 THEN 'active' WHEN age > 14 THEN 'rejected' ELSE s END AS status FROM x""")
def stale_candidates(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    i, rows = F.col("event_id"), e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return rows.select(i, scoring.stale_status(_pick(["candidate", "active", "rejected"], i % 3), i % 4, (F.unix_micros("now") - F.unix_micros("ts")) / 8.64e10, 14).alias("status"))


@query("""WITH g AS (SELECT user_id, coalesce(max(CASE WHEN event_id % 2 = 0 THEN ts END), max(ts)) AS latest FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN TIMESTAMP '2024-01-30 12:00:00' - latest BETWEEN INTERVAL 0 SECOND AND INTERVAL 6 HOUR THEN latest ELSE TIMESTAMP '2024-01-30 12:00:00' END AS at FROM g""")
def presented_times(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").withColumn("published", F.when(F.col("event_id") % 2 == 0, F.col("ts")))
    return e.groupBy("user_id").agg(scoring.presented_at(F.col("published"), F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("at"))


@query("SELECT event_type, max(ts) AS last, TIMESTAMP '2024-01-30 12:00:00' - max(ts) >= INTERVAL 3 HOUR AS due FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1")
def run_due(spark: SparkSession, base: str) -> DataFrame:
    now = "2024-01-30 12:00:00"
    calls = table(spark, base, "events").filter((F.col("event_type") == "signup") & (F.col("ts") < now))
    return usage.due(calls, "ts", F.lit(now).cast("timestamp"), 6).select(F.lit("signup").alias("event_type"), "last", "due")


@query("""SELECT user_id, round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13' THEN value ELSE 0 END), 4) AS spent, 40.0::DOUBLE AS cap, spent >= 40 AS over_cap, greatest(round(40 - spent, 4), 0) AS remaining FROM events GROUP BY user_id""")
def spend_on_a_day(spark: SparkSession, base: str) -> DataFrame:
    """As of a time that is given, not the end of the log."""
    return usage.spend_against_cap(table(spark, base, "events"), "user_id", "ts", "value", 40.0, "2024-01-12 17:00:00")


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS day, user_id, event_id, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY day, user_id ORDER BY value DESC, event_id) = 1)
SELECT day, event_id, CAST(row_number() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS INT) AS position FROM f QUALIFY position <= 6""")
def daily_topics(spark: SparkSession, base: str) -> DataFrame:
    """Six topics a day, one a ticker (the limit is the feature's)."""
    e = table(spark, base, "events").filter("value IS NOT NULL").withColumn("day", F.col("ts").cast("date"))
    return sequential.daily_cap(e, "day", "event_id", [F.desc("value"), F.col("event_id")], "user_id", 6).select("day", "event_id", "position")


@query("""SELECT * FROM (SELECT o_orderkey, unnest(['statement', 'invalidation_1', 'invalidation_2']) AS chunk_key, unnest([o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'p ' || o_orderstatus END, o_orderstatus]) AS text FROM orders) WHERE trim(text) <> ''""")
def belief_chunks(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders").select("o_orderkey", F.col("o_orderpriority").alias("statement"), F.array(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.concat(F.lit("p "), "o_orderstatus")), F.col("o_orderstatus")).alias("inv"))
    return tables.belief_chunks(o, "o_orderkey", "statement", "inv")


@query("""SELECT user_id, arg_max(event_type, ts) AS event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 96 HOUR AND event_id % 10 > 0 GROUP BY user_id""")
def cached_snapshot(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").withColumn("event_type", F.when(F.col("event_id") % 10 > 0, F.col("event_type")))
    return tables.snapshot(e, "user_id", "event_type", "ts", "2024-01-20 00:00:00", 96)


@query("SELECT user_id, event_id, round((value - p) / p * 100, 6) AS pct FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p <> 0")
def movers(spark: SparkSession, base: str) -> DataFrame:
    """Percent against the value before itself, not its size."""
    e = table(spark, base, "events").withColumn("pct", indicators.change(F.col("value"), ["user_id"], "event_id", absolute=False))
    return e.filter("pct IS NOT NULL").select("user_id", "event_id", F.round("pct", 6).alias("pct"))


@query("""SELECT * FROM (SELECT event_type, date_trunc('hour', ts) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY t DESC) <= 40""")
def hourly_bars(spark: SparkSession, base: str) -> DataFrame:
    """The last 40 hours of each key, cut after they are computed."""
    b = indicators.bars(table(spark, base, "events"), ["event_type"], "ts", "value", "1 hour", "event_id")
    return indicators.latest(b, ["event_type"], "t", 40).select("event_type", "t", "open", "high", "low", "close", "n")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def hydrated_customers(spark: SparkSession, base: str) -> DataFrame:
    """Rows with the latest record of another table, null where there is none."""
    last = relational.latest_per_key(table(spark, base, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    c = table(spark, base, "customer").select("c_custkey")
    return c.join(last.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left")
