"""Usage and spend: totals, conditional and nested aggregates, roll-ups, sessions, quotas, token cost, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.fixed_values import HEALTH_RULES
from tidewire.operators import health, usage
from tidewire.operators.relational import nth_of_sorted
from tidewire.plans.catalogue import query
from tidewire.sources.tables import table

K = "CAST(json_extract(props, '$.k') AS BIGINT)"
DAY = "strftime(ts, '%Y-%m-%d')"


def events(spark: SparkSession, base: str) -> DataFrame:
    """The events with ``k`` from their properties and their day as text."""
    e = table(spark, base, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0)::BIGINT AS errors FROM events")
def usage_total(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    return e.agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)), F.lit(0)).alias("errors")
    )


@query(f"SELECT event_type, {DAY} AS day, count(*) AS n, round(sum(value), 4) AS total, sum({K})::BIGINT AS tokens FROM events GROUP BY event_type, {DAY}")
def usage_by_key(spark: SparkSession, base: str) -> DataFrame:
    return events(spark, base).groupBy("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum("k").alias("tokens"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 20")
def usage_top_spenders(spark: SparkSession, base: str) -> DataFrame:
    spent = table(spark, base, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return spent.orderBy(F.desc("total"), "user_id").limit(20)


@query("SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, count(*) AS n, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (event_type = 'error') / count(*), 3) END AS error_rate FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') >= 2")
def usage_status(spark: SparkSession, base: str) -> DataFrame:
    counted = table(spark, base, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    return counted.filter("errors >= 2").withColumn("error_rate", F.round(F.col("errors") / F.col("n"), 3))


@query("SELECT coalesce(event_type, 'TOTAL') AS event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(spark: SparkSession, base: str) -> DataFrame:
    rolled = table(spark, base, "events").rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rolled.select(F.coalesce("event_type", F.lit("TOTAL")).alias("event_type"), "n", "total")


@query(f"""
WITH p AS (SELECT user_id || '/' || {DAY} AS request_id, event_type AS phase, event_id, value, {K} AS tokens FROM events),
a AS (SELECT request_id, round(sum(value), 4) AS cost, sum(tokens)::BIGINT AS tokens, max(CASE WHEN phase = 'error' THEN 'error' ELSE 'ok' END) AS x,
  bool_or(phase = 'error') AS failed, arg_max(event_id, CASE WHEN phase = 'purchase' THEN 1000000000 + event_id ELSE -event_id END) AS lead FROM p GROUP BY request_id)
SELECT request_id, 'aggregate' AS phase, cost, tokens, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status, lead AS model FROM a
UNION ALL SELECT request_id, phase, round(value, 4), tokens, CASE WHEN phase = 'error' THEN 'error' ELSE 'ok' END, event_id FROM p
""")
def usage_aggregate_rows(spark: SparkSession, base: str) -> DataFrame:
    phases = events(spark, base).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "day").alias("request_id"), F.col("event_type").alias("phase"), F.col("value").alias("cost"), F.col("k").alias("tokens"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("event_id").alias("model")
    )
    out = usage.with_aggregate_rows(phases, "request_id", "phase", "cost", ["tokens"], "status", "model", response="purchase", order="model")
    return out.withColumn("cost", F.round("cost", 4))


@query(f"""
WITH g AS (SELECT user_id, {DAY} AS day, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS has FROM events GROUP BY user_id, {DAY} HAVING count(*) >= 2)
SELECT day, count(*) AS missing FROM g WHERE has = 0 GROUP BY day
""")
def usage_missing_aggregate(spark: SparkSession, base: str) -> DataFrame:
    per = events(spark, base).groupBy("user_id", "day").agg(F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("has"), F.count("*").alias("n"))
    return per.filter("n >= 2 AND has = 0").groupBy("day").agg(F.count("*").alias("missing"))


@query("""
WITH s AS (SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)::BIGINT AS replies, sum(length(text))::BIGINT AS chars,
  count(DISTINCT role) AS roles, arg_max(length(text), turn) FILTER (role = 'assistant') AS last_reply_chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT * FROM s
""")
def session_metrics(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "conversations")
    mine = F.col("role") == "assistant"
    return c.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum(F.when(mine, 1).otherwise(0)).alias("replies"), F.sum(F.length("text")).alias("chars"), F.countDistinct("role").alias("roles"), F.max_by(F.when(mine, F.length("text")).cast("bigint"), F.when(mine, F.col("turn"))).alias("last_reply_chars"), F.max("turn").alias("last_turn")
    )


@query("""
WITH r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM events WHERE value IS NOT NULL),
m AS (SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type)
SELECT r.event_type, value AS p50, mean FROM r JOIN m ON m.event_type = r.event_type WHERE k = n // 2 + 1
""")
def latency_p50_upper(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    return nth_of_sorted(e, ["event_type"], "value", "p50").join(e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), "event_type")


@query("""
WITH a AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) FILTER (ts >= now - INTERVAL 1 HOUR) AS h1, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS h24, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS d7,
  round(coalesce(sum(value) FILTER (ts >= now - INTERVAL 7 DAY), 0), 4) AS value_d7 FROM events, a GROUP BY event_type
""")
def multi_window_counts(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    at = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    inside = lambda s: F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {s}")
    return at.groupBy("event_type").agg(F.count_if(inside("1 HOUR")).alias("h1"), F.count_if(inside("24 HOURS")).alias("h24"), F.count_if(inside("7 DAYS")).alias("d7"), F.round(F.coalesce(F.sum(F.when(inside("7 DAYS"), F.col("value"))), F.lit(0.0)), 4).alias("value_d7"))


@query("""
WITH b AS (SELECT user_id, CASE WHEN count(*) = 1 THEN '1' WHEN count(*) = 2 THEN '2' WHEN count(*) <= 5 THEN '3-5' ELSE '6+' END AS bin
  FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT d.bin, count(b.user_id) AS users FROM (VALUES ('1'), ('2'), ('3-5'), ('6+')) d(bin) LEFT JOIN b ON b.bin = d.bin GROUP BY d.bin
""")
def member_histogram(spark: SparkSession, base: str) -> DataFrame:
    sizes = table(spark, base, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    return usage.size_histogram(sizes, "n").withColumnRenamed("n", "users")


@query("""
WITH b AS (SELECT CASE WHEN event_type LIKE 'p%' THEN 'buy' WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type ILIKE '%ERR%' THEN 'fault' ELSE 'other' END AS bucket, user_id FROM events)
SELECT bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM b GROUP BY bucket
""")
def reason_buckets(spark: SparkSession, base: str) -> DataFrame:
    t = F.col("event_type")
    bucket = F.when(t.startswith("p"), "buy").when(t.isin("view", "click"), "browse").when(t.ilike("%ERR%"), "fault").otherwise("other")
    return table(spark, base, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
WITH n AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_suppkey, n, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS INT) AS rank FROM n QUALIFY rank <= 5
""")
def top_contributors(spark: SparkSession, base: str) -> DataFrame:
    n = table(spark, base, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "l_suppkey"))).filter("rank <= 5")


@query(f"""
WITH a AS (SELECT max({DAY}) AS today FROM events),
s AS (SELECT user_id, coalesce(round(sum(value) FILTER ({DAY} = today), 4), 0) AS spent FROM events, a GROUP BY user_id)
SELECT user_id, spent, 5.0::DOUBLE AS cap, spent >= 5.0 AS over_cap, greatest(round(5.0::DOUBLE - spent, 4), 0) AS remaining FROM s
""")
def spend_vs_quota(spark: SparkSession, base: str) -> DataFrame:
    return usage.spend_against_cap(table(spark, base, "events"), "user_id", "ts", "value", 5.0)


@query(f"""
WITH m AS (SELECT event_id, event_type || '-' || (event_id % 7) AS model_id, {K} AS tokens FROM events),
t(ord, key, rate_in, rate_out) AS (VALUES (1, 'view-3', 3.0, 15.0), (2, 'view', 0.8, 4.0), (3, 'click', 0.25, 1.25), (4, 'purchase-1', 15.0, 75.0), (5, 'purchase', 5.0, 25.0)),
h AS (SELECT event_id, min(ord) AS ord FROM m JOIN t ON contains(model_id, key) GROUP BY event_id)
SELECT m.event_id, m.model_id, coalesce(round((tokens * 1000 * rate_in + tokens * 100 * rate_out) / 1e6, 6), 0.0) AS cost_usd
FROM m LEFT JOIN h ON h.event_id = m.event_id LEFT JOIN t ON t.ord = h.ord
""")
def token_cost(spark: SparkSession, base: str) -> DataFrame:
    calls = events(spark, base).select("event_id", F.concat_ws("-", "event_type", (F.col("event_id") % 7).cast("string")).alias("model_id"), (F.col("k") * 1000).alias("input"), (F.col("k") * 100).alias("output"))
    rates = [("view-3", {"input": 3.0, "output": 15.0}), ("view", {"input": 0.8, "output": 4.0}), ("click", {"input": 0.25, "output": 1.25}), ("purchase-1", {"input": 15.0, "output": 75.0}), ("purchase", {"input": 5.0, "output": 25.0})]
    return calls.select("event_id", "model_id", usage.cost_of(F.col("model_id"), rates).alias("cost_usd"))


@query(f"""
SELECT event_id, {K} AS k, CASE WHEN {K} >= 50 THEN 'deep' ELSE 'quick' END AS mode FROM events WHERE {K} IS NOT NULL
""")
def json_props(spark: SparkSession, base: str) -> DataFrame:
    e = events(spark, base).filter("k IS NOT NULL")
    return e.select("event_id", "k", F.when(F.col("k") >= 50, "deep").otherwise("quick").alias("mode"))


@query(f"""
WITH d AS (SELECT user_id, {DAY} AS day, list_sort(list_distinct(list({K}))) AS ids FROM events GROUP BY ALL),
u AS (SELECT user_id, unnest(ids) AS id FROM d)
SELECT user_id, count(DISTINCT id) AS n, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM u GROUP BY user_id
""")
def nested_id_union(spark: SparkSession, base: str) -> DataFrame:
    """Ids that sit in arrays of records, united over the columns of a row and over rows."""
    e = events(spark, base)
    rows = e.groupBy("user_id", "day").agg(F.collect_set(F.struct(F.array("k").alias("source_doc_ids"))).alias("claims"))
    ids = rows.select("user_id", F.explode(F.flatten(F.transform("claims", lambda x: x["source_doc_ids"]))).alias("id")).filter("id IS NOT NULL")
    return ids.groupBy("user_id").agg(F.countDistinct("id").alias("n"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))


@query(f"""
WITH d AS (SELECT user_id, {DAY} AS day, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS pos FROM d),
b AS (SELECT user_id, coalesce(min(pos) FILTER (errors = 0), count(*) + 1) - 1 AS streak FROM r GROUP BY user_id),
m AS (SELECT user_id, streak, (SELECT sum(errors) FROM d WHERE d.user_id = b.user_id)::BIGINT AS errors, (SELECT max(day) FROM d WHERE d.user_id = b.user_id) AS last_day FROM b)
SELECT user_id, streak, CASE WHEN streak >= 3 THEN 'critical' WHEN streak >= 1 OR errors >= 20 THEN 'warn' ELSE 'ok' END AS status,
  (CASE WHEN streak >= 3 THEN 1 ELSE 0 END + CASE WHEN streak >= 1 THEN 1 ELSE 0 END + CASE WHEN errors >= 20 THEN 1 ELSE 0 END)::INT AS findings FROM m
""")
def health_findings(spark: SparkSession, base: str) -> DataFrame:
    days = events(spark, base).groupBy("user_id", "day").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    streak = health.failure_streak(days.withColumn("ok", F.col("errors") == 0), ["user_id"], "day", "ok", "streak")
    metrics = streak.join(days.groupBy("user_id").agg(F.sum("errors").alias("errors")), "user_id")
    rules = [
        health.Rule("run_failures", "critical", F.col("streak") >= 3, "runs keep failing"),
        health.Rule("run_failure", "warn", F.col("streak") >= 1, "the last run failed"),
        health.Rule("many_errors", "warn", F.col("errors") >= 20, "many errors"),
    ]
    judged = health.findings(metrics, rules)
    return judged.select("user_id", "streak", "status", F.size("findings").alias("findings"))


@query("""
WITH c AS (SELECT *, lower(text) AS low FROM conversations),
h AS (SELECT conv_id, turn FROM c WHERE contains(low, 'the') AND contains(low, 'and'))
SELECT h.conv_id, h.turn, string_agg(c.turn || ':' || c.role, ' ' ORDER BY c.turn) AS context FROM h JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c) c ON c.conv_id = h.conv_id
JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c) m ON m.conv_id = h.conv_id AND m.turn = h.turn
WHERE c.k BETWEEN m.k - 1 AND m.k + 1 GROUP BY h.conv_id, h.turn
""")
def keyword_context(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "conversations").select("conv_id", "turn", "role", F.lower("text").alias("low"))
    return usage.keyword_context(c, ["conv_id"], "turn", "low", ["the", "and"], 1, F.concat_ws(":", F.col("turn").cast("string"), "role"))


# ------------------------------------------------------------------ rules of health as a table


def _measured() -> list[tuple[str, int, float]]:
    """Every metric that a rule names, the number that its values stay below, and their unit, so that they fall on both sides of its thresholds."""
    most: dict[str, float] = {}
    for _, _, metric, _, low, high, other, guard, _, guarded in HEALTH_RULES:
        for name, t in ((metric, high or low), (other, None), (guard, guarded)):
            if name:
                most[name] = max(most.get(name, 0.0), t or 0.0)
    return [(n, 10, 0.1) if 0 < t < 1 else (n, int(2 * t) + 3, 1.0) for n, t in most.items()]


def _rules_sql() -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rules = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in HEALTH_RULES)
    metrics = ", ".join(f"({j}, '{n}', {m}, {u})" for j, (n, m, u) in enumerate(_measured()))
    return f"""WITH r(code, severity, metric, cmp, t, t2, other, guard, gcmp, gt) AS (VALUES {rules}), k(j, name, m, u) AS (VALUES {metrics}),
u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), v AS (SELECT user_id, name, CASE WHEN (user_id + j) % 11 > 0 THEN (n * (j + 3) + user_id * 7) % m * u END::DOUBLE AS x FROM u, k),
h AS (SELECT v.user_id, r.*, v.x, g.x AS gx, o.x AS ox FROM v JOIN r ON r.metric = v.name LEFT JOIN v g ON g.user_id = v.user_id AND g.name = r.guard LEFT JOIN v o ON o.user_id = v.user_id AND o.name = r.other),
f AS (SELECT DISTINCT user_id, code, severity FROM h WHERE
  CASE cmp WHEN 'missing' THEN x IS NULL WHEN '>' THEN x > t WHEN '>=' THEN x >= t WHEN '<' THEN x < t WHEN '==' THEN x = t WHEN 'outside' THEN x < t OR x > t2 WHEN 'below' THEN x < ox WHEN 'differs' THEN x IS NOT NULL AND x IS DISTINCT FROM ox END
  AND (guard IS NULL OR CASE gcmp WHEN 'present' THEN gx IS NOT NULL WHEN '>' THEN gx > gt WHEN '>=' THEN gx >= gt WHEN '==' THEN gx = gt END))"""


def _judged(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of every user, all arithmetic on the number of events and the id, judged by the table of rules."""
    users = table(spark, base, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    value = lambda j, m, u: F.when((F.col("user_id") + j) % 11 > 0, (F.col("n") * (j + 3) + F.col("user_id") * 7) % m * F.lit(u))
    named = F.array(*[F.struct(F.lit(n).alias("metric"), value(j, m, u).cast("double").alias("value")) for j, (n, m, u) in enumerate(_measured())])
    return health.judged_by(users.select("user_id", F.inline(named)), ["user_id"], "metric", "value", spark.createDataFrame(HEALTH_RULES, health.RULE))


@query(f"{_rules_sql()} SELECT user_id, code, severity FROM f")
def health_rule_findings(spark: SparkSession, base: str) -> DataFrame:
    return _judged(spark, base)[0].select("user_id", "code", "severity")


@query(f"{_rules_sql()} SELECT u.user_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warn') AS warn, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (severity = 'warn') > 0 THEN 'warn' ELSE 'ok' END AS status FROM u LEFT JOIN f ON f.user_id = u.user_id GROUP BY u.user_id")
def health_rule_status(spark: SparkSession, base: str) -> DataFrame:
    return _judged(spark, base)[1]
