"""Series: averages, strength, bars, returns, changes, as-of and nearest joins, decay and composite scores, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.operators import indicators, scoring
from tidewire.operators.relational import as_of_join, effective_rank as best_recent_rank, latest_per_key, nearest_join
from tidewire.plans.catalogue import query
from tidewire.sources.tables import table
from tidewire.streaming import ingest

DAILY = "d AS (SELECT o_orderpriority AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS close FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS i, count(*) OVER (PARTITION BY k) AS n FROM d)"


def daily(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))


#: So many digits that a mean of n closes of two digits is not halfway between two.
EMA_DIGITS = [(20, 4), (50, 4), (200, 5)]
SMAS = ", ".join(f"CASE WHEN i >= {n} THEN round(avg(close) OVER (PARTITION BY k ORDER BY day ROWS {n - 1} PRECEDING), 6) END AS sma_{n}" for n in (20, 50, 200))


def _ema_sql(n: int) -> str:
    """The exponential average as the sum that it is: the mean of the first n and every close since, by their age."""
    return f"""e{n} AS (SELECT a.k, a.day, sum(CASE WHEN b.i = {n} THEN s.seed ELSE b.close * 2.0 / {n + 1} END * power({n - 1}.0 / {n + 1}, a.i - b.i)) AS ema_{n}
  FROM r a JOIN (SELECT k, avg(close) AS seed FROM r WHERE i <= {n} GROUP BY k HAVING count(*) = {n}) s ON s.k = a.k JOIN r b ON b.k = a.k AND b.i BETWEEN {n} AND a.i GROUP BY a.k, a.day)"""


EMAS = ", ".join(_ema_sql(n) for n in (20, 50, 200))
RSI = """g AS (SELECT k, day, i, close - lag(close) OVER (PARTITION BY k ORDER BY day) AS d FROM r),
w AS (SELECT k, avg(greatest(d, 0)) AS up, avg(greatest(-d, 0)) AS down FROM g WHERE i BETWEEN 2 AND 15 GROUP BY k HAVING count(*) = 14),
x AS (SELECT a.k, a.day, sum(CASE WHEN b.i = 15 THEN w.up ELSE greatest(b.d, 0) / 14 END * power(13.0 / 14, a.i - b.i)) AS up, sum(CASE WHEN b.i = 15 THEN w.down ELSE greatest(-b.d, 0) / 14 END * power(13.0 / 14, a.i - b.i)) AS down
  FROM g a JOIN w ON w.k = a.k JOIN g b ON b.k = a.k AND b.i BETWEEN 15 AND a.i WHERE a.i >= 15 GROUP BY a.k, a.day),
rsi AS (SELECT k, day, CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi_14 FROM x)"""


@query(f"WITH {DAILY} SELECT k, day, {SMAS}, CASE WHEN n < 200 THEN 'insufficient_history' END AS disabled FROM r")
def sma_set(spark: SparkSession, base: str) -> DataFrame:
    out = indicators.indicator_set(daily(spark, base), ["k"], "day", "close", emas=(), rsi=None)
    return out.select("k", "day", *[F.round(f"sma_{n}", 6).alias(f"sma_{n}") for n in (20, 50, 200)], F.col("disabled_reason").alias("disabled"))


@query(f"WITH {DAILY}, {EMAS} SELECT r.k, r.day, round(ema_20, 4) AS ema_20, round(ema_50, 4) AS ema_50, round(ema_200, 5) AS ema_200 FROM r JOIN e20 ON e20.k = r.k AND e20.day = r.day LEFT JOIN e50 ON e50.k = r.k AND e50.day = r.day LEFT JOIN e200 ON e200.k = r.k AND e200.day = r.day")
def ema_set(spark: SparkSession, base: str) -> DataFrame:
    """The averages from the first day that has the shortest."""
    out = indicators.indicator_set(daily(spark, base), ["k"], "day", "close", smas=(), rsi=None)
    return out.filter("ema_20 IS NOT NULL").select("k", "day", *[F.round(f"ema_{n}", d).alias(f"ema_{n}") for n, d in EMA_DIGITS])


@query(f"WITH {DAILY}, {RSI} SELECT k, day, round(rsi_14, 5) AS rsi_14 FROM rsi")
def rsi_14(spark: SparkSession, base: str) -> DataFrame:
    out = indicators.indicator_set(daily(spark, base), ["k"], "day", "close", smas=(), emas=())
    return out.filter("rsi_14 IS NOT NULL").select("k", "day", F.round("rsi_14", 5).alias("rsi_14"))


@query(f"""WITH {DAILY.replace("o_orderpriority AS k", "o_orderpriority || ' ' || o_orderstatus AS k")}, {EMAS}, {RSI}
SELECT r.k, r.day, r.i AS bar, {SMAS}, round(ema_20, 4) AS ema_20, round(ema_50, 4) AS ema_50, round(ema_200, 5) AS ema_200, round(rsi_14, 5) AS rsi_14, CASE WHEN n < 200 THEN 'sma_200,ema_200' END AS disabled, CASE WHEN n < 200 THEN 'insufficient_history' END AS disabled_reason
FROM r LEFT JOIN e20 USING (k, day) LEFT JOIN e50 USING (k, day) LEFT JOIN e200 USING (k, day) LEFT JOIN rsi USING (k, day)""")
def indicator_set(spark: SparkSession, base: str) -> DataFrame:
    """All averages and the strength of every day's bar, by priority and status."""
    o = table(spark, base, "orders")
    d = o.groupBy(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))
    out = indicators.indicator_set(d, ["k"], "day", "close")
    return out.select("k", "day", "bar", *[F.round(f"sma_{n}", 6).alias(f"sma_{n}") for n in (20, 50, 200)], *[F.round(f"ema_{n}", d).alias(f"ema_{n}") for n, d in EMA_DIGITS], F.round("rsi_14", 5).alias("rsi_14"), "disabled", "disabled_reason")


def _ohlcv(width: str) -> str:
    return f"""
SELECT event_type, strftime(time_bucket(INTERVAL '{width}', ts), '%Y-%m-%d %H:%M') AS t, arg_min(value, {{'a': ts, 'b': event_id}}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {{'a': ts, 'b': event_id}}) AS close,
  count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY 1, 2"""


def _bars(spark: SparkSession, base: str, every: str) -> DataFrame:
    out = indicators.bars(table(spark, base, "events"), ["event_type"], "ts", "value", every, "event_id")
    return out.withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm")).withColumn("total", F.round("total", 4))


@query(_ohlcv("5 minutes"))
def ohlcv_5m(spark: SparkSession, base: str) -> DataFrame:
    return _bars(spark, base, "5 minutes")


@query(_ohlcv("1 day"))
def ohlcv_1d(spark: SparkSession, base: str) -> DataFrame:
    return _bars(spark, base, "1 day")


@query("""
SELECT event_type, arg_min(value, {'a': ts, 'b': event_id}) AS first_open, arg_max(value, {'a': ts, 'b': event_id}) AS last_close,
  CASE WHEN arg_min(value, {'a': ts, 'b': event_id}) <> 0 THEN round((arg_max(value, {'a': ts, 'b': event_id}) - arg_min(value, {'a': ts, 'b': event_id})) / arg_min(value, {'a': ts, 'b': event_id}) * 100, 5) END AS return_pct FROM events GROUP BY event_type
""")
def window_return(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").withColumn("at", F.struct("ts", "event_id"))
    return indicators.window_return(e, ["event_type"], "at", "value", "value").withColumn("return_pct", F.round("return_pct", 5))


@query(f"""
WITH {DAILY}, m AS (SELECT k, day, close, i, n, lag(close, 5) OVER w AS c5, lag(close, 21) OVER w AS c21 FROM r WINDOW w AS (PARTITION BY k ORDER BY day)),
p AS (SELECT k, day, CASE WHEN c5 <> 0 THEN (close - c5) / abs(c5) * 100 END AS week, CASE WHEN c21 <> 0 THEN (close - c21) / abs(c21) * 100 END AS month FROM m WHERE i = n)
SELECT k, day, round(greatest(coalesce(abs(week) / 3, 0), coalesce(abs(month) / 5, 0)), 6) AS salience, CASE WHEN coalesce(abs(week) / 3, 0) >= coalesce(abs(month) / 5, 0) THEN '1w' ELSE '1mo' END AS span
FROM p WHERE greatest(coalesce(abs(week) / 3, 0), coalesce(abs(month) / 5, 0)) >= 1
""")
def price_events(spark: SparkSession, base: str) -> DataFrame:
    return indicators.price_events(daily(spark, base), ["k"], "day", "close").select("k", "day", F.round("salience", 6).alias("salience"), "span")


# ------------------------------------------------------------------ as of, nearest, latest


@query(f"WITH {DAILY} SELECT k, day, round(close - coalesce(lag(close) OVER (PARTITION BY k ORDER BY day), close), 2) AS delta FROM r")
def snapshot_delta(spark: SparkSession, base: str) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("k").orderBy("day"))
    return daily(spark, base).select("k", "day", F.round(F.col("close") - F.coalesce(before, "close"), 2).alias("delta"))


@query(f"WITH {DAILY}, t AS (SELECT max(day) AS today FROM d) SELECT k, max(day) AS day, arg_max(close, day) AS prev_close FROM d, t WHERE day < today GROUP BY k")
def prev_score_asof(spark: SparkSession, base: str) -> DataFrame:
    d = daily(spark, base)
    before = d.join(F.broadcast(d.agg(F.max("day").alias("today")))).filter("day < today")  # one row
    return before.groupBy("k").agg(F.max("day").alias("day"), F.max_by("close", "day").alias("prev_close"))


@query("""
WITH o AS (SELECT o_custkey AS user_id, o_orderdate::DATE + 9000 AS d, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1),
o2 AS (SELECT user_id, (DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER))::TIMESTAMP AS t, max(o_totalprice) AS price FROM (SELECT o_custkey AS user_id, * FROM orders) GROUP BY ALL)
SELECT e.event_id, e.user_id, o2.price AS asof_price FROM events e ASOF LEFT JOIN o2 ON e.user_id = o2.user_id AND e.ts >= o2.t
""")
def event_delta_asof(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders")
    prices = o.select(F.col("o_custkey").alias("user_id"), F.date_add(F.lit("2024-01-01"), (F.col("o_orderkey") % 30).cast("int")).cast("timestamp").alias("t"), F.col("o_totalprice").alias("price")).groupBy("user_id", "t").agg(F.max("price").alias("price"))
    e = table(spark, base, "events").select("event_id", "user_id", "ts")
    return as_of_join(e, prices, ["user_id"], "ts", "t", ["price"]).select("event_id", "user_id", "asof_price")


MONTHLY = "m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS m, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL)"


def monthly(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


@query(f"""
WITH {MONTHLY}, j AS (SELECT a.k, a.m, a.v, b.v AS old, row_number() OVER (PARTITION BY a.k, a.m ORDER BY abs(date_diff('day', a.m - 365, b.m)), b.m) AS r FROM m a LEFT JOIN m b ON a.k = b.k AND abs(date_diff('day', a.m - 365, b.m)) <= 15)
SELECT k, strftime(m, '%Y-%m') AS month, v, old, CASE WHEN old <> 0 THEN round((v - old) / abs(old) * 100, 2) END AS yoy FROM j WHERE r = 1
""")
def yoy_nearest(spark: SparkSession, base: str) -> DataFrame:
    m = monthly(spark, base)
    j = nearest_join(m, m, ["k"], "m", "m", -365, 15, ["v"])
    return j.select("k", F.date_format("m", "yyyy-MM").alias("month"), "v", F.col("near_v").alias("old"), F.when(F.col("near_v") != 0, F.round((F.col("v") - F.col("near_v")) / F.abs("near_v") * 100, 2)).alias("yoy"))


@query(f"WITH {MONTHLY}, q AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY m) AS b FROM m) SELECT k, strftime(m, '%Y-%m') AS month, CASE WHEN b <> 0 THEN round((v - b) / abs(b) * 100, 2) END AS qoq FROM q")
def qoq(spark: SparkSession, base: str) -> DataFrame:
    return monthly(spark, base).select("k", F.date_format("m", "yyyy-MM").alias("month"), F.round(indicators.change(F.col("v"), ["k"], "m"), 2).alias("qoq"))


@query("SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_per_period(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders")
    return latest_per_key(o, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 2")
def one_per_publisher(spark: SparkSession, base: str) -> DataFrame:
    return latest_per_key(table(spark, base, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 2)


RANKED = """a AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS rank FROM a),
l AS (SELECT DISTINCT day FROM r ORDER BY day DESC LIMIT 2), e AS (SELECT user_id, min(rank) AS effective_rank FROM r WHERE day IN (SELECT day FROM l) GROUP BY user_id)"""


def _effective(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    ranked = a.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "user_id")).cast("bigint"))
    return best_recent_rank(ranked, "day", "user_id", "rank")


@query(f"WITH {RANKED} SELECT * FROM e")
def effective_rank(spark: SparkSession, base: str) -> DataFrame:
    return _effective(spark, base)


@query(f"WITH {RANKED} SELECT CASE WHEN effective_rank <= 10 THEN 'top' WHEN effective_rank BETWEEN 11 AND 50 THEN 'middle' ELSE 'tail' END AS tier, count(*) AS n FROM e GROUP BY 1")
def trend_tiers(spark: SparkSession, base: str) -> DataFrame:
    r = F.col("effective_rank")
    return _effective(spark, base).groupBy(F.when(r <= 10, "top").when(r.between(11, 50), "middle").otherwise("tail").alias("tier")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ scores

LINKS = "l AS (SELECT o_custkey AS thesis, max(o_orderdate) FILTER (o_orderstatus <> 'P') AS last, any_value(10 + o_custkey % 111) AS h FROM orders GROUP BY o_custkey), n AS (SELECT max(o_orderdate) AS now FROM orders)"
FRESH = "f AS (SELECT thesis, CASE WHEN last IS NULL THEN 0 ELSE round_even(100 * power(0.5, greatest(0, epoch(now - last) / 86400.0) / (h / 2.0)), 0)::INT END AS freshness FROM l, n)"
TAIL = """t AS (SELECT o_custkey AS thesis, round_even(avg(CASE WHEN ret IS NOT NULL THEN round_even(50 + 50 * greatest(-1, least(1, CASE WHEN o_orderkey % 2 = 0 THEN ret ELSE -ret END / 10)), 0) END), 0)::INT AS tailwind
FROM (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 30000 - 8 END AS ret FROM orders) GROUP BY o_custkey)"""


def _fresh(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders")
    links = o.groupBy(F.col("o_custkey").alias("thesis")).agg(F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))).alias("last"))
    at = links.join(F.broadcast(o.agg(F.max("o_orderdate").alias("now"))))  # one row
    return at.select("thesis", scoring.freshness(F.col("last"), 10 + F.col("thesis") % 111, F.col("now")).alias("freshness"))


def _tail(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders")
    rows = o.select(F.col("o_custkey").alias("thesis"), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("direction"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice") / 30000 - 8).alias("ret"))
    return scoring.tailwind(rows, "thesis", "direction", "ret")


@query(f"WITH {LINKS}, {FRESH} SELECT * FROM f")
def freshness_score(spark: SparkSession, base: str) -> DataFrame:
    return _fresh(spark, base)


@query(f"WITH {TAIL} SELECT * FROM t")
def tailwind_score(spark: SparkSession, base: str) -> DataFrame:
    return _tail(spark, base)


@query(f"""WITH {LINKS}, {FRESH}, {TAIL}, c AS (SELECT f.thesis, freshness, tailwind, CASE WHEN coalesce(tailwind, CASE WHEN f.thesis % 3 = 0 THEN 40 END) IS NOT NULL THEN round_even((freshness + coalesce(tailwind, CASE WHEN f.thesis % 3 = 0 THEN 40 END)) / 2, 0)::INT ELSE freshness END AS composite FROM f LEFT JOIN t ON t.thesis = f.thesis)
SELECT *, CASE WHEN composite >= 75 THEN 'strong' WHEN composite >= 60 THEN 'building' ELSE 'quiet' END AS signal FROM c""")
def composite_score(spark: SparkSession, base: str) -> DataFrame:
    both = _fresh(spark, base).join(_tail(spark, base), "thesis", "left")
    score = scoring.composite(F.col("freshness"), F.col("tailwind"), F.when(F.col("thesis") % 3 == 0, 40))
    return both.withColumn("composite", score).withColumn("signal", scoring.signal_band(F.col("composite")))


# ------------------------------------------------------------------ streams


def _stream(spark: SparkSession, base: str) -> DataFrame:
    """The events as a stream; the pattern matches the one table, as a stream's path is a folder or a pattern."""
    return ingest.read(spark, f"{base}/[e]vents.parquet", spark.read.parquet(f"{base}/events.parquet").schema)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT (user_id, event_type)) AS n FROM events GROUP BY 1")
def stream_dedup_daily(spark: SparkSession, base: str) -> DataFrame:
    """A stream without repeats of (user, type, day), then counted by day."""
    rows = _stream(spark, base).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = ingest.run_available(ingest.deduplicated(rows, "ts", ["user_id", "event_type", "day"], "31 days").select("day", "event_id"))
    return spark.read.schema("day string, event_id bigint").parquet(out).groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT event_id, epoch(TIMESTAMP '2024-01-30 00:00:00' - ts) / 3600.0 > 48 AS late FROM events")
def stream_late_split(spark: SparkSession, base: str) -> DataFrame:
    fresh, late = ingest.split_late(_stream(spark, base), "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"))
    parts = [(ingest.run_available(x.select("event_id")), flag) for x, flag in ((fresh, False), (late, True))]
    read = [spark.read.schema("event_id bigint").parquet(p).withColumn("late", F.lit(flag)) for p, flag in parts]
    return read[0].unionByName(read[1])
