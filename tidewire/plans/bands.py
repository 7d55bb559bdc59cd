"""Bands and advice, whole forms of texts and numbers, taxonomies, the windows of the feed and the bars of a view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.fixed_values import PRESCRIPTIONS, TIMEFRAMES
from tidewire.functions import text as T
from tidewire.functions import values
from tidewire.operators import indicators, scoring
from tidewire.plans.catalogue import query
from tidewire.plans.forms import _list, _pick
from tidewire.sources import vendor
from tidewire.sources.tables import table

STATUSES, RELATIONS = ["active", "stressed", "resolved", None], ["supports", "stresses", "unrelated", None]
SAYS = {k: "'" + v.replace("'", "''") + "'" for k, v in PRESCRIPTIONS.items()}


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderkey * 7 % 101 AS INT) END AS score, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey * 7 % 101 + o_orderkey % 9 - 4 AS INT) END AS prev, {_list(STATUSES)}[CAST(o_orderkey % 4 AS INT) + 1] AS status,
  {_list(RELATIONS)}[CAST(o_orderkey // 4 % 4 AS INT) + 1] AS rel, o_orderkey % 100 / 100.0::DOUBLE AS conf FROM orders)
SELECT o_orderkey, CASE WHEN status = 'stressed' THEN 'stressed' WHEN score - prev >= 3 THEN 'strengthening' WHEN score - prev <= -3 THEN 'weakening' ELSE 'stable' END AS trend, CASE WHEN score IS NULL THEN 'medium' WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS signal,
  CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.75 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN conf >= 0.7 AND rel = 'supports' THEN 'Supports' WHEN conf >= 0.7 AND rel = 'stresses' THEN 'Stresses' END AS chip,
  CASE WHEN status = 'resolved' THEN NULL WHEN status = 'stressed' OR score IS NULL OR score <= 34 THEN {SAYS["review"]} WHEN score >= 70 AND rel = 'stresses' THEN {SAYS["challenged"]} WHEN score >= 70 THEN {SAYS["holding"]} WHEN rel = 'stresses' THEN {SAYS["trending"]} ELSE {SAYS["watch"]} END AS advice FROM o""")
def thesis_bands(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("o_orderkey")
    score = F.when(i % 13 > 0, (i * 7 % 101).cast("int"))
    before = F.when(i % 11 > 0, (i * 7 % 101 + i % 9 - 4).cast("int"))
    status, relation, sure = _pick(STATUSES, i % 4), _pick(RELATIONS, F.floor(i / 4) % 4), i % 100 / 100.0
    return table(spark, base, "orders").select(i, scoring.trend_of(score, before, status).alias("trend"), scoring.signal_of(score).alias("signal"), scoring.confidence_tier(sure).alias("tier"), scoring.chip(relation, sure).alias("chip"), scoring.prescription(score, status, relation).alias("advice"))


KIND_OF, LABEL_OF = ["story", "x", None, "other"], ["good", "unclear", "no_value", None]


@query(f"""WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT event_id, {_list(KIND_OF)}[CAST(event_id % 4 AS INT) + 1] AS kind, {_list(LABEL_OF)}[CAST(event_id // 4 % 4 AS INT) + 1] AS label, epoch(now - ts) / 3600 AS age FROM events, n)
SELECT event_id, kind FROM e WHERE (coalesce(kind, 'story') = 'story' AND age <= 72 AND coalesce(label NOT IN ('unclear', 'no_value'), TRUE)) OR (kind = 'x' AND age <= 48)""")
def feed_window(spark: SparkSession, base: str) -> DataFrame:
    """Candidates of the feed: each kind within its own hours, stories without those that a label excludes."""
    e = table(spark, base, "events")
    i, rows = F.col("event_id"), e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    aged = rows.select(i, _pick(KIND_OF, i % 4).alias("kind"), _pick(LABEL_OF, F.floor(i / 4) % 4).alias("label"), ((F.unix_micros("now") - F.unix_micros("ts")) / 3.6e9).alias("age"))
    return aged.filter(scoring.in_feed(F.col("kind"), F.col("age"), F.col("label"))).select("event_id", "kind")


ALIASES = {"energy.oil_gas": ["energy.oil_gas"], "oil_gas": ["energy.oil_gas"], "tech": ["tech.software", "tech.chips"], "travel & leisure": ["consumer.leisure"], "consumer.leisure": ["consumer.leisure"]}
LABELS = [["Oil Gas", "TECH "], ["tech", "energy.oil_gas", "oil gas"], ["Travel & Leisure", None, "unknown"], [], ["Consumer.Leisure", "tech"]]
CANONICAL = sorted({x for xs in ALIASES.values() for x in xs})


@query(f"""WITH m(k, v) AS (VALUES {", ".join(f"('{k}', {_list(v)})" for k, v in ALIASES.items())}), d AS (SELECT doc_id, [{", ".join(_list(x) if x else "[]::VARCHAR[]" for x in LABELS)}][CAST(doc_id % {len(LABELS)} AS INT) + 1] AS raw FROM documents),
x AS (SELECT doc_id, unnest(raw) AS label, unnest(range(len(raw))) AS i FROM d), y AS (SELECT doc_id, i, coalesce(a.v, b.v) AS v FROM x LEFT JOIN m a ON a.k = replace(lower(trim(label)), ' ', '_') LEFT JOIN m b ON b.k = lower(trim(label))),
z AS (SELECT doc_id, i, unnest(v) AS c, unnest(range(len(v))) AS j FROM y WHERE v IS NOT NULL), f AS (SELECT doc_id, c, min(i * 100 + j) AS pos FROM z GROUP BY doc_id, c)
SELECT d.doc_id, coalesce((SELECT string_agg(c, ',' ORDER BY pos) FROM f WHERE f.doc_id = d.doc_id), '') AS labels FROM d""")
def taxonomy_labels(spark: SparkSession, base: str) -> DataFrame:
    """Raw labels as those of the taxonomy, by a map of aliases."""
    raw = F.element_at(F.array(*[F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in LABELS]), (F.col("doc_id") % len(LABELS)).cast("int") + 1)
    aliases = F.create_map(*[y for k, v in ALIASES.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    return table(spark, base, "documents").select("doc_id", F.array_join(T.normal_label_list(raw, aliases, F.array(*[F.lit(c) for c in CANONICAL])), ",").alias("labels"))


@query(r"""SELECT doc_id, len(s) AS n, list_aggregate(list_transform(s, lambda x: length(x)), 'max')::INT AS longest, sha1(array_to_string(s, chr(10))) AS hash
FROM (SELECT doc_id, string_split(regexp_replace(replace(text, '. ', '.  '), '([.!?])\s+(["A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)""")
def sentence_split(spark: SparkSession, base: str) -> DataFrame:
    """All sentences of every text."""
    s = T.sentences(F.replace("text", F.lit(". "), F.lit(".  ")))
    return table(spark, base, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, lambda x: F.length(x))).alias("longest"), F.sha1(F.array_join(s, "\n")).alias("hash"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize('"Fees" - it''s fine... ' || split_part(text, chr(10), 1))), 'ß', 'ss'), '\s+', ' ', 'g')) AS form FROM documents""")
def quote_forms(spark: SparkSession, base: str) -> DataFrame:
    """First lines behind a phrase with odd characters, in the form that quotations are compared in."""
    line = F.concat(F.lit("“Fees” – it’s ﬁne… "), T.first_line(F.col("text")))
    return table(spark, base, "documents").select("doc_id", T.quote_form(line).alias("form"))


PALETTE = ["red", "green", "blue", "amber", "teal"]
NUMBERS = [" 12 ", "-3.50", "1e3", "12f", "x", "", ".5", "1,234 up", "7.", None, "+9", "down -1,002"]


@query(f"""WITH e AS (SELECT event_id, value, event_type || '-' || event_id AS slug, {_list(NUMBERS)}[CAST(event_id % {len(NUMBERS)} AS INT) + 1] AS t, CASE WHEN event_id % 19 > 0 THEN (event_id % 7 - 3) * power(10.0, event_id % 11) * 1.25 END AS v FROM events),
f AS (SELECT *, abs(v) AS a, CASE WHEN v < 0 THEN '-' ELSE '' END AS s FROM e)
SELECT event_id, {_list(PALETTE)}[CAST(list_sum(list_transform(string_split(slug, ''), lambda x: ascii(x))) % {len(PALETTE)} AS INT) + 1] AS colour,
  CASE WHEN a >= 1e9 THEN s || printf('%.2f', a / 1e9) || 'B' WHEN a >= 1e6 THEN s || printf('%.2f', a / 1e6) || 'M' WHEN a >= 1e3 THEN s || printf('%.1f', a / 1e3) || 'K' WHEN a IS NOT NULL THEN s || printf('%.2f', a) END AS count,
  CASE WHEN a >= 1e9 THEN s || '$' || printf('%.2f', a / 1e9) || 'B' WHEN a >= 1e6 THEN s || '$' || printf('%.2f', a / 1e6) || 'M' WHEN a >= 1e3 THEN s || '$' || printf('%.1f', a / 1e3) || 'K' WHEN a IS NOT NULL THEN s || '$' || printf('%.2f', a) END AS usd,
  CASE WHEN regexp_full_match(trim(t), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim(t) AS DOUBLE) END AS f, CASE WHEN regexp_full_match(trim(t), '[+-]?\\d+') THEN CAST(trim(t) AS BIGINT) END AS i, TRY_CAST(replace(regexp_extract(t, '-?\\d[\\d,]*'), ',', '') AS BIGINT) AS first FROM f""")
def number_forms(spark: SparkSession, base: str) -> DataFrame:
    """Short forms of numbers, numbers that texts are, and colours of names."""
    i = F.col("event_id")
    v = F.when(i % 19 > 0, (i % 7 - 3) * F.pow(F.lit(10.0), i % 11) * 1.25)
    t = _pick(NUMBERS, i % len(NUMBERS))
    slug = F.concat("event_type", F.lit("-"), i.cast("string"))
    return table(spark, base, "events").select(i, T.colour(slug, PALETTE).alias("colour"), T.count_short(v).alias("count"), T.usd_short(v).alias("usd"), values.float_or_null(t).alias("f"), values.int_or_null(t).alias("i"), values.first_int(t).alias("first"))


def _frames_sql(warmup: bool) -> str:
    start = {"5 minutes": "time_bucket(INTERVAL '5 minutes', ts)", "1 hour": "date_trunc('hour', ts)", "1 day": "date_trunc('day', ts)", "7 days": "date_trunc('week', ts)"}
    return " UNION ALL ".join(f"""SELECT event_type, '{frame}' AS timeframe, strftime({start[width]}, '%Y-%m-%d %H:%M') AS t, arg_min(value, {{'a': ts, 'b': event_id}}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {{'a': ts, 'b': event_id}}) AS close, count(*) AS n
FROM events, n WHERE value IS NOT NULL AND ts <= now AND ts >= now - INTERVAL {warm if warmup else back} DAY GROUP BY 1, {start[width]}""" for frame, (width, _, back, warm) in TIMEFRAMES.items())


def _frames(spark: SparkSession, base: str, warmup: bool) -> DataFrame:
    """The bars of every view up to a week before the last event."""
    e = table(spark, base, "events")
    ticks = e.join(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("now"))))  # one row
    found = [indicators.timeframe_bars(ticks, ["event_type"], "ts", "value", "event_id", f, F.col("now"), warmup) for f in TIMEFRAMES]
    return reduce(DataFrame.unionByName, found).select("event_type", "timeframe", F.date_format("t", "yyyy-MM-dd HH:mm").alias("t"), "open", "high", "low", "close", "n")


@query(f"WITH n AS (SELECT max(ts) - INTERVAL 7 DAY AS now FROM events) {_frames_sql(False)}")
def timeframe_bars(spark: SparkSession, base: str) -> DataFrame:
    return _frames(spark, base, False)


@query(f"WITH n AS (SELECT max(ts) - INTERVAL 7 DAY AS now FROM events) {_frames_sql(True)}")
def timeframe_bars_warm(spark: SparkSession, base: str) -> DataFrame:
    return _frames(spark, base, True)


# ------------------------------------------------------------------ answers of vendors, of all shapes, by the id

FILING = """'{"filing_date": ' || CASE WHEN k % 5 = 0 THEN '""' WHEN k % 7 = 0 THEN 'null' ELSE '"2024-01-0' || (k % 9 + 1) || '"' END || ', "reporting_person": ' || CASE WHEN k % 3 = 0 THEN 'null' WHEN k % 4 = 0 THEN '""' ELSE '"P' || (k % 10) || '"' END || ', "name": ' || CASE WHEN k % 2 = 0 THEN '"N"' ELSE 'null' END
 || ', "relationship": "dir", "transactions": [{"transaction_code": "P", "shares": ' || (k % 50) || '.5, "price_per_share": "x"}, 3, {"shares": null, "direction": "D", "extra": 1}]}'"""
EMPTY = """'{"filing_date": "2024-02-0' || (k % 8 + 1) || '", "transactions": ' || CASE WHEN k % 2 = 0 THEN '[]' WHEN k % 3 = 0 THEN 'null' ELSE '"none"' END || '}'"""
INSIDER = f"""CASE WHEN k % 17 = 0 THEN 'broken {{' WHEN k % 13 = 0 THEN '[1, 2]' WHEN k % 11 = 0 THEN '{{"filings": null}}' ELSE '{{"cik": "' || k || '", "filings": [' || {FILING} || ', 7, ' || {EMPTY} || ']}}' END"""
FUNDAMENTALS = """CASE WHEN k % 17 = 0 THEN 'broken' ELSE '{"income": {"as_of": "2024", "revenue": ' || CASE WHEN k % 3 = 0 THEN 'null' ELSE '' || k END || '}, "balance": ' || CASE WHEN k % 4 = 0 THEN 'null' WHEN k % 4 = 1 THEN '{"as_of": "2024"}' WHEN k % 4 = 2 THEN '[3]' ELSE '{"cash": 0, "debt": null}' END || '}' END"""
SECTIONS = {"income": ["as_of", "revenue", "net"], "balance": ["as_of", "cash", "debt"], "calendar": ["next"]}


def _answers(spark: SparkSession, base: str, text: str) -> DataFrame:
    return table(spark, base, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(text).alias("answer"))


@query(f"""WITH d AS (SELECT k, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT k, {INSIDER} AS j FROM (SELECT c_custkey AS k FROM customer))), f AS (SELECT k, unnest(json_extract(j, '$.filings[*]')) AS f, unnest(range(len(json_extract(j, '$.filings[*]'))))::INT AS filing FROM d),
g AS (SELECT k, filing, f, nullif(f->>'filing_date', '') AS filing_date, coalesce(nullif(f->>'reporting_person', ''), nullif(f->>'name', ''), 'unknown') AS person, CASE WHEN json_type(f, '$.transactions') = 'ARRAY' THEN json_extract(f, '$.transactions[*]') ELSE [] END AS ts FROM f WHERE json_type(f) = 'OBJECT'),
t AS (SELECT *, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS t, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE range(len(ts)) END)::INT AS tx FROM g WHERE filing_date IS NOT NULL)
SELECT k, filing, tx AS "transaction", filing_date, person AS reporting_person, f->>'relationship' AS relationship, t->>'transaction_code' AS transaction_code, TRY_CAST(t->>'shares' AS DOUBLE) AS shares, t->>'direction' AS direction, TRY_CAST(t->>'price_per_share' AS DOUBLE) AS price_per_share FROM t WHERE len(ts) = 0 OR json_type(t) = 'OBJECT'""")
def insider_rows(spark: SparkSession, base: str) -> DataFrame:
    """Transactions of insiders; filings without any are rows too."""
    return vendor.insider_transactions(_answers(spark, base, INSIDER), "k", "answer").select("k", "filing", "transaction", "filing_date", "reporting_person", "relationship", "transaction_code", "shares", "direction", "price_per_share")


@query(f"""WITH d AS (SELECT k, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT k, {FUNDAMENTALS} AS j FROM (SELECT c_custkey AS k FROM customer)))
SELECT k, 'income' AS section, coalesce(coalesce(j->'income'->>'revenue', j->'income'->>'net') IS NOT NULL, FALSE) AS filled FROM d UNION ALL SELECT k, 'balance', coalesce(coalesce(j->'balance'->>'cash', j->'balance'->>'debt') IS NOT NULL, FALSE) FROM d UNION ALL SELECT k, 'calendar', FALSE FROM d""")
def fundamentals_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Which sections of an answer say anything."""
    return vendor.coverage(_answers(spark, base, FUNDAMENTALS), "k", "answer", SECTIONS)
