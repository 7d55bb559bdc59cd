"""Hits and pairs, symbols, lints, verdicts, slates, and single rows, on orders, events, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.fixed_values import BANNED_WORDS, DATAPOINT, EXPLICIT_TICKER, SUFFIX_REGIONS, TARGET_PHRASES, TEMPORAL, VENDOR_FUTURES
from tidewire.functions import text as T
from tidewire.functions import values
from tidewire.operators import matching, retrieval, social
from tidewire.plans.catalogue import query
from tidewire.plans.vectors import QUERIES_SQL, asking
from tidewire.sources import sinks
from tidewire.sources.tables import table


def _sql(p: str) -> str:
    return p.replace("'", "''")


@query("""SELECT o_orderkey, coalesce(a.k, b.k) AS resolved FROM orders LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING') a ON a.k = o_custkey
LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem) b ON b.k = o_custkey""")
def resolved_in_either(spark: SparkSession, base: str) -> DataFrame:
    """Customers of orders that one of two registries has; the second has keys several times."""
    first = table(spark, base, "customer").filter("c_mktsegment = 'BUILDING'")
    out = matching.resolved_in_either(table(spark, base, "orders"), "o_custkey", first, table(spark, base, "lineitem"), "c_custkey", "l_suppkey")
    return out.select("o_orderkey", "resolved")


@query(f"""WITH {QUERIES_SQL}, t AS (SELECT qid AS query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS INT) AS rank FROM c QUALIFY rank <= 10)
SELECT query_id, t.vec_id, rank, lang, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS position FROM t LEFT JOIN documents ON doc_id = t.vec_id WHERE t.vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def described_hits(spark: SparkSession, base: str) -> DataFrame:
    """The ten nearest of each query with their documents; those of low quality go after the cut."""
    v, q = asking(spark, base)
    hits = retrieval.cosine_top_k(v, "vec_id", "embedding", q, "qid", "qe", 10).select("query_id", "vec_id", "rank")
    documents = table(spark, base, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    low = table(spark, base, "labels").filter("quality = 0").select(F.col("doc_id").alias("vec_id")).distinct()
    return matching.described_hits(hits, "vec_id", documents, low, [F.col("rank")])


@query("""WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['T' || o_orderkey % 4] END AS own, CASE WHEN o_custkey % 6 = 0 THEN [] ELSE ['T' || o_custkey % 4, 'T' || o_custkey % 3] END AS other FROM orders)
SELECT o_orderkey, o_custkey FROM p WHERE (list_has_any(own, other) OR len(own) = 0 OR len(other) = 0) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 50 = o_custkey % 50 AND l_discount * 10 >= 0.7)""")
def matchable_pairs(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders").select("o_orderkey", "o_custkey").withColumn("k", F.col("o_custkey") % 50)
    t = lambda c, n: F.concat(F.lit("T"), (F.col(c) % n).cast("string"))
    none = F.array().cast("array<string>")
    own, other = F.when(F.col("o_orderkey") % 5 == 0, none).otherwise(F.array(t("o_orderkey", 4))), F.when(F.col("o_custkey") % 6 == 0, none).otherwise(F.array(t("o_custkey", 4), t("o_custkey", 3)))
    links = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 50).alias("k"), (F.col("l_discount") * 10).alias("confidence"))
    return matching.matchable(o, own, other, ["o_orderkey", "k"], links, "confidence").select("o_orderkey", "o_custkey")


VERDICTS = ["Supports ", "STRESSES", "stresses", "unrelated", "maybe", None]


@query("""WITH v AS (SELECT event_id, ['Supports ', 'STRESSES', 'stresses', 'unrelated', 'maybe', NULL][CAST(event_id % 6 AS INT) + 1] AS r, CASE event_id % 4 WHEN 0 THEN '1.7' WHEN 1 THEN 'high' WHEN 2 THEN '-2' ELSE CAST(event_id % 100 / 100.0 AS VARCHAR) END AS conf,
  CASE event_id % 3 WHEN 0 THEN ' Rates  rise ' || chr(10) || 'again!?' WHEN 1 THEN 'demand falls' ELSE ' ' END AS cand FROM events),
n AS (SELECT event_id, CASE WHEN lower(trim(r)) IN ('supports', 'stresses') THEN lower(trim(r)) END AS relation, greatest(0, least(1, coalesce(try_cast(conf AS DOUBLE), 0))) AS confidence, event_id % 3 AS k FROM v)
SELECT event_id, relation, round(confidence, 6) AS confidence, CASE WHEN relation = 'stresses' THEN CASE k WHEN 0 THEN 'Rates rise again.' WHEN 1 THEN 'Demand falls' END END AS matched FROM n WHERE relation IS NOT NULL""")
def judged_links(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("event_id")
    relation = F.element_at(F.array(*[F.lit(x) for x in VERDICTS]), (i % 6).cast("int") + 1)
    sure = F.when(i % 4 == 0, "1.7").when(i % 4 == 1, "high").when(i % 4 == 2, "-2").otherwise((i % 100 / 100.0).cast("string"))
    candidate = F.when(i % 3 == 0, " Rates  rise \nagain!?").when(i % 3 == 1, "demand falls").otherwise(" ")
    v = table(spark, base, "events").select("event_id", relation.alias("relation"), sure.alias("confidence"), candidate.alias("candidate"), F.array(F.lit("Rates rise again."), F.lit("Demand falls")).alias("known"))
    return matching.judged(v, "relation", "confidence", "candidate", "known").select("event_id", "relation", F.round("confidence", 6).alias("confidence"), "matched")


# ------------------------------------------------------------------ symbols

SUFFIXES = ["", ".AX", ".T", ".L", ".DE", ".HK", "=X", "=F", "-USD", ".KS", "-B"]
SYMBOL_SQL = f"CASE WHEN p_partkey % 37 = 0 THEN '^IX' || p_partkey % 9 WHEN p_partkey % 41 = 0 THEN ['GC=F', 'CL=F', 'BZ=F', 'NG=F'][CAST(p_partkey % 4 AS INT) + 1] ELSE 'S' || p_partkey % 7 || [{', '.join(repr(x) for x in SUFFIXES)}][CAST(p_partkey % {len(SUFFIXES)} AS INT) + 1] END"


def _symbols(spark: SparkSession, base: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n).cast("int") + 1)
    symbol = F.when(k % 37 == 0, F.concat(F.lit("^IX"), (k % 9).cast("string"))).when(k % 41 == 0, pick(list(VENDOR_FUTURES), 4)).otherwise(F.concat(F.lit("S"), (k % 7).cast("string"), pick(SUFFIXES, len(SUFFIXES))))
    return table(spark, base, "part").select("p_partkey", symbol.alias("symbol"), F.when(k % 13 == 0, "OWN.X").when(k % 13 == 1, "").alias("own"))


REGION_SQL = " ".join(f"WHEN ends_with(s, '{x}') THEN '{','.join(r)}'" for x, r in SUFFIX_REGIONS)


@query(f"""WITH s AS (SELECT p_partkey, {SYMBOL_SQL} AS s, CASE WHEN p_partkey % 13 = 0 THEN 'OWN.X' END AS own FROM part)
SELECT p_partkey, s AS symbol, CASE {REGION_SQL} WHEN s[1] = '^' THEN 'global' ELSE 'north_america' END AS regions,
  coalesce(own, CASE s WHEN 'GC=F' THEN 'GOLD' WHEN 'CL=F' THEN 'WTI' WHEN 'BZ=F' THEN 'BRENT' WHEN 'NG=F' THEN 'NATURAL_GAS' ELSE CASE WHEN s[1] = '^' THEN substr(s, 2) || '.INDX' WHEN ends_with(s, '=X') THEN substr(s, 1, len(s) - 2) || '.FOREX' WHEN ends_with(s, '-USD') THEN s || '.CC'
    WHEN ends_with(s, '.KS') THEN substr(s, 1, len(s) - 3) || '.KO' WHEN ends_with(s, '.T') THEN substr(s, 1, len(s) - 2) || '.TSE' WHEN ends_with(s, '.L') THEN substr(s, 1, len(s) - 2) || '.LSE' WHEN ends_with(s, '.DE') THEN substr(s, 1, len(s) - 3) || '.XETRA' WHEN ends_with(s, '.HK') THEN s ELSE s || '.US' END END) AS vendor FROM s""")
def symbol_forms(spark: SparkSession, base: str) -> DataFrame:
    s = _symbols(spark, base)
    return s.select("p_partkey", "symbol", F.array_join(values.regions_of(F.col("symbol")), ",").alias("regions"), values.vendor_symbol(F.col("symbol"), F.col("own")).alias("vendor"))


@query("""WITH r AS (SELECT 'NK' || chr(CAST(65 + n_nationkey AS INT)) AS symbol, CASE n_nationkey % 6 WHEN 0 THEN 'rate' WHEN 1 THEN NULL WHEN 2 THEN 'fx' ELSE 'equity' END AS cls FROM nation UNION ALL SELECT 'NKABF', 'equity'),
c AS (SELECT c_custkey, unnest(['NK' || chr(CAST(65 + c_custkey % 26 AS INT)), 'NKABF', 'ZZZ', 'NK' || chr(CAST(65 + c_custkey % 7 AS INT))]) AS symbol, generate_subscripts([1, 2, 3, 4], 1) AS pos FROM customer)
SELECT c_custkey, coalesce(string_agg(c.symbol, ',' ORDER BY pos) FILTER (r.symbol IS NOT NULL AND coalesce(cls, '') NOT IN ('rate', 'fx') AND c.symbol <> 'NKABF'), '') AS shown FROM c LEFT JOIN r ON r.symbol = c.symbol GROUP BY c_custkey""")
def shown_symbols(spark: SparkSession, base: str) -> DataFrame:
    letter = lambda c, n: F.concat(F.lit("NK"), F.chr(F.lit(65) + F.col(c) % n))
    k = F.col("n_nationkey") % 6
    nation = table(spark, base, "nation").select(letter("n_nationkey", 99).alias("symbol"), F.when(k == 0, "rate").when(k == 1, None).when(k == 2, "fx").otherwise("equity").alias("cls"))
    registry = nation.unionByName(spark.createDataFrame([("NKABF", "equity")], "symbol string, cls string"))
    rows = table(spark, base, "customer").select("c_custkey", F.array(letter("c_custkey", 26), F.lit("NKABF"), F.lit("ZZZ"), letter("c_custkey", 7)).alias("symbols"))
    return matching.shown_symbols(rows, "c_custkey", "symbols", registry, "symbol", "cls").select("c_custkey", F.array_join("shown", ",").alias("shown"))


REGISTRY = [("AAA", ["Alpha Works", "Alphaco"], "equity"), ("BBB", ["Beta Oil"], "equity"), ("ETF1", ["Oil Fund"], "etf"), ("CCC", ["xyz"], "equity"), ("DDD", ["Delta & Sons", "Delta"], "equity"), ("EEE", [], "equity"), *((x, [f"{x} Trust"], "etf") for x in ("GLD", "SLV", "TLT", "UNG", "USO", "XLE"))]
SEEDS = [("energy", 0, "ETF1", ["crude oil", "Brent"]), ("energy", 1, "NONE", ["x"]), ("energy", 2, "XLE", ["oil majors"]), ("energy", 3, "UNG", []), ("energy", 4, "USO", ["crude"]), ("macro", 0, "BBB", ["beta barrels"]), ("macro", 1, "TLT", ["Treasury yield"]), ("macro", 2, "GLD", ["bullion"]), ("macro", 3, "SLV", []), ("macro", 4, "USO", ["oil price"])]
SLATE = 6
TITLES = ["Alphaco and DELTA agree", "$CCC up; NYSE: AAA flat", "xyz and Deltas", "Beta oil, (NASDAQ:DDD) and $ZZZ", ""]


@query(f"""WITH m AS (SELECT CAST(floor(item_id / 4) AS BIGINT) AS grp, item_id, [{', '.join(repr(x) for x in TITLES)}][CAST(item_id % 5 AS INT) + 1] AS title FROM benchmark),
n AS (SELECT grp, item_id, row_number() OVER (PARTITION BY grp ORDER BY item_id) AS member, title || chr(10) AS t FROM m),
reg(symbol, names, cls) AS (VALUES {', '.join(f"('{s}', {n if n else '[]::VARCHAR[]'}, '{c}')" for s, n, c in REGISTRY)}), seed(sector, pos, symbol, phrases) AS (VALUES {', '.join(f"('{a}', {i}, '{b}', {c if c else '[]::VARCHAR[]'})" for a, i, b, c in SEEDS)}),
g AS (SELECT DISTINCT grp FROM m), sec AS (SELECT grp, grp % 5 AS place, 'energy' AS sector FROM g WHERE grp % 2 = 0 UNION ALL SELECT grp, 2, 'macro' FROM g WHERE grp % 3 = 0),
x AS (SELECT grp, member, unnest(regexp_extract_all(t, '{_sql(EXPLICIT_TICKER)}', 1)) AS symbol, unnest(range(0, len(regexp_extract_all(t, '{_sql(EXPLICIT_TICKER)}', 1)))) AS pos FROM n),
al AS (SELECT grp, member, symbol, instr(lower(t), lower(a)) AS pos FROM n, (SELECT symbol, unnest(names) AS a FROM reg WHERE cls = 'equity') WHERE length(a) >= 4 AND regexp_matches(t, '(?i)(^|[^a-z0-9])' || regexp_escape(a) || '([^a-z0-9]|$)')),
c AS (SELECT grp, 1 AS tier, 0 AS m, 0 AS p, 'bbb ' AS symbol FROM g WHERE grp % 4 = 1 UNION ALL SELECT grp, 2, member, pos, symbol FROM x UNION ALL SELECT grp, 3, member, pos, symbol FROM al UNION ALL SELECT grp, 4, place, pos, symbol FROM sec JOIN seed USING (sector)),
f AS (SELECT grp, symbol, names, min((tier, m, p)) AS first FROM (SELECT grp, tier, m, p, upper(trim(symbol)) AS symbol FROM c) JOIN reg USING (symbol) GROUP BY ALL),
ph AS (SELECT grp, symbol, flatten(list(phrases)) AS ps FROM sec JOIN seed USING (sector) GROUP BY ALL),
a AS (SELECT f.grp, f.symbol, first, list_distinct(list_concat(names, coalesce(ps, []))) AS al FROM f LEFT JOIN ph ON ph.grp = f.grp AND ph.symbol = f.symbol)
SELECT grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY first, symbol) AS INT) AS position, symbol, (SELECT string_agg(u, '|' ORDER BY length(u) DESC, u) FROM (SELECT unnest(al) AS u)) AS aliases FROM a QUALIFY len(al) > 0 AND position <= {SLATE}""")
def ticker_slate(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "benchmark").select((F.col("item_id") / 4).cast("bigint").alias("grp"), "item_id", F.element_at(F.array(*[F.lit(x) for x in TITLES]), (F.col("item_id") % 5).cast("int") + 1).alias("title"))
    g = m.select("grp").distinct()
    attached = g.filter("grp % 4 = 1").select("grp", F.lit(0).alias("pos"), F.lit("bbb ").alias("symbol"))
    sectors = g.filter("grp % 2 = 0").select("grp", (F.col("grp") % 5).alias("pos"), F.lit("energy").alias("sector")).unionByName(g.filter("grp % 3 = 0").select("grp", F.lit(2).alias("pos"), F.lit("macro").alias("sector")))
    registry = spark.createDataFrame(REGISTRY, "symbol string, aliases array<string>, asset_class string")
    seeds = spark.createDataFrame(SEEDS, "sector string, pos int, symbol string, aliases array<string>")
    slate = matching.ticker_slate(m, "grp", [F.col("item_id")], F.col("title"), F.lit(None).cast("string"), attached, sectors, registry, seeds, SLATE)
    return slate.select("grp", "position", "symbol", F.array_join("aliases", "|").alias("aliases"))


# ------------------------------------------------------------------ lints

CLAIMS = ["Structural headwinds; re-rating restructural", "SPX above 7,000 or $3.5K, $1.2 trillion", "overnight — elevated multiples!", "Brent past 95% to 5.5 bps", "calm, This Week", "10-year at 4.5%", ""]
CLAIM_SQL = "[" + ", ".join(f"'{c}'" for c in CLAIMS) + f"][CAST(doc_id % {len(CLAIMS)} AS INT) + 1] || ' ' || coalesce(substr(text, 1, 300), '')"


@query(f"""WITH d AS (SELECT doc_id, {CLAIM_SQL} AS t FROM documents)
SELECT doc_id, array_to_string([w FOR w IN [{', '.join(f"CASE WHEN regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}]){w}([^\\p{{L}}\\p{{N}}]|$)') THEN '{w}' END" for w in BANNED_WORDS)}, CASE WHEN contains(t, '—') THEN 'em-dash' END] IF w IS NOT NULL], ',') AS banned,
  (SELECT coalesce(string_agg(h, '|' ORDER BY i), '') FROM (SELECT h, min(i) AS i FROM (SELECT unnest(hs) AS h, unnest(range(len(hs))) AS i FROM (SELECT [trim(z) FOR z IN list_concat(regexp_extract_all(t, '(?i)\\$\\d[\\d,\\.]*(?:\\s*(?:K|M|B|T|trillion|billion|million)\\b)?'), regexp_extract_all(t, '(?i)\\b(?:{'|'.join(TARGET_PHRASES)})\\s+\\$?\\d[\\d,\\.]*\\s*(?:%|bps|bp)?\\b'))] AS hs)) GROUP BY h)) AS targets,
  nullif(regexp_extract(t, '(?i){TEMPORAL}', 1), '') AS temporal, regexp_matches(t, '{DATAPOINT}') AS datapoint FROM d""")
def lints(spark: SparkSession, base: str) -> DataFrame:
    claim = F.element_at(F.array(*[F.lit(c) for c in CLAIMS]), (F.col("doc_id") % len(CLAIMS)).cast("int") + 1)
    d = table(spark, base, "documents").select("doc_id", F.concat(claim, F.lit(" "), F.coalesce(F.substring("text", 1, 300), F.lit(""))).alias("t"))
    t = F.col("t")
    return d.select("doc_id", F.array_join(T.banned_words(t), ",").alias("banned"), F.array_join(T.price_targets(t), "|").alias("targets"), T.temporal_phrase(t).alias("temporal"), T.has_datapoint(t).alias("datapoint"))


# ------------------------------------------------------------------ order, single rows, merges


@query("""WITH l AS (SELECT 0 AS lane, o_orderkey AS id, CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderdate AS DATE) END AS day, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS seq FROM orders
UNION ALL SELECT 1, l_orderkey * 10 + l_linenumber, CAST(l_shipdate AS DATE), row_number() OVER (ORDER BY l_orderkey, l_linenumber) FROM lineitem) SELECT lane, id, day FROM l ORDER BY day DESC NULLS LAST, lane, seq LIMIT 200""")
def evidence_lanes(spark: SparkSession, base: str) -> DataFrame:
    """The 200 newest of two lanes (the number is the report's)."""
    o = table(spark, base, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderdate").cast("date")).alias("day"), F.col("o_totalprice").alias("weight"), F.lit(0).alias("n"))
    li = table(spark, base, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("day"), F.lit(0.0).alias("weight"), F.col("l_linenumber").alias("n"))
    return matching.lanes_by_date([o, li], "day", [[F.desc("weight"), F.col("id")], [F.col("id")]], 200).select("lane", "id", "day")


@query("""SELECT 'ev_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0') AS next_id FROM (SELECT coalesce(max(try_cast(substr(id, 4) AS BIGINT)), 0) + 1 AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'ev_x' || event_id WHEN event_id % 5 = 0 THEN 'other_' || event_id * 100 ELSE 'ev_' || event_id END AS id FROM events) WHERE starts_with(id, 'ev_'))""")
def next_event_id(spark: SparkSession, base: str) -> DataFrame:
    i = F.col("event_id")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return matching.next_id(table(spark, base, "events").select(F.when(i % 9 == 0, name("ev_x", i)).when(i % 5 == 0, name("other_", i * 100)).otherwise(name("ev_", i)).alias("id")), "id", "ev")


@query("""WITH t AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id, ts FROM l, t WHERE epoch(now - ts) <= 48 * 3600""")
def fresh_latest(spark: SparkSession, base: str) -> DataFrame:
    """Each user's latest purchase, if it is no older than 48 hours at the end of the log."""
    from tidewire.operators.relational import latest_per_key

    e = table(spark, base, "events")
    last = latest_per_key(e.filter("event_type = 'purchase'"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.join(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(values.age_hours(F.col("ts"), F.col("now")) <= 48).select("user_id", "event_id", "ts")  # one row


@query("""WITH t AS (SELECT max(ts) AS now FROM events) SELECT event_id, event_type, ts FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1), t WHERE epoch(now - ts) <= 720 * 3600""")
def latest_brief(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").select("event_id", "event_type", "ts")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return matching.latest_if_fresh(e, "event_id", "ts", now, 720)


@query("SELECT doc_id, source FROM documents ORDER BY md5('week' || doc_id), doc_id LIMIT 30")
def sample_30(spark: SparkSession, base: str) -> DataFrame:
    return matching.sample(table(spark, base, "documents").select("doc_id", "source"), "doc_id", 30, "week")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def third_page(spark: SparkSession, base: str) -> DataFrame:
    return matching.page(table(spark, base, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 20, 40)


@query("SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value, max(event_id) AS event_id, min(ts) AS ts FROM events GROUP BY 1, 2")
def collapsed_owners(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").withColumn("day", F.col("ts").cast("date"))
    return matching.collapsed(e, ["user_id", "day"], ["value", "event_id"], "ts")


@query("SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 0.5 ELSE value END AS value FROM events WHERE NOT (event_type = 'error' AND value < 50)")
def pruned_and_updated(spark: SparkSession, base: str) -> DataFrame:
    """Rows of a source under a threshold deleted, then columns of some rows changed by key."""
    e = table(spark, base, "events").select("event_id", "event_type", "value")
    changes = e.filter("event_id % 10 < 2").select("event_id", F.when(F.col("event_id") % 10 == 1, 0.5).alias("value"))
    return sinks.update_by_key(sinks.delete_where(e, (F.col("event_type") == "error") & (F.col("value") < 50)), changes, ["event_id"])


@query("""WITH b AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN ts END AS ts, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE value END AS close, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE value + 1 END AS adj FROM events)
SELECT event_id FROM b WHERE ts IS NOT NULL AND coalesce(nullif(adj, 0), close, 0) <> 0""")
def valid_bars(spark: SparkSession, base: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    b = table(spark, base, "events").select(i, F.when(i % 7 > 0, F.col("ts")).alias("ts"), F.when(i % 5 == 0, 0.0).when(i % 5 == 1, None).otherwise(v).alias("close"), F.when(i % 3 == 0, 0.0).when(i % 3 == 1, None).otherwise(v + 1).alias("adj"))
    return matching.valid_bars(b, "close", "ts", "adj").select("event_id")


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > count(*) FILTER (o_orderstatus = 'O') THEN 'F' ELSE 'O' END AS label FROM orders GROUP BY o_custkey")
def majority_label(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").groupBy("o_custkey").agg(values.majority(F.col("o_orderstatus"), "F", "O").alias("label"))


@query("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey = l_suppkey")
def composite_lookup(spark: SparkSession, base: str) -> DataFrame:
    li = table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = table(spark, base, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_suppkey"), "o_totalprice")
    return li.join(o, ["l_orderkey", "l_suppkey"], "left").select("l_orderkey", "l_linenumber", "o_totalprice")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value >= 20")
def optional_filters(spark: SparkSession, base: str) -> DataFrame:
    """Of four filters of a listing the two that were given."""
    given = {"kind": "click", "least": 20.0, "user": None, "until": None}
    e = table(spark, base, "events")
    asked = values.all_of(
        F.col("event_type") == given["kind"] if given["kind"] is not None else None, F.col("value") >= given["least"] if given["least"] is not None else None,
        F.col("user_id") == given["user"] if given["user"] is not None else None, F.col("ts") < given["until"] if given["until"] is not None else None,
    )
    return e.filter(asked).select("event_id", "event_type", "value")


@query("""WITH x AS (SELECT user_id, CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%dT%H:%M') END AS d, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END AS h FROM events),
y AS (SELECT *, try_cast(substr(d, 1, 10) AS DATE) AS day FROM x)
SELECT user_id, count(*) AS found, count(day) AS dated, count(*) FILTER (day >= DATE '2024-01-15') AS recent, count(*) FILTER (day >= DATE '2024-01-15' AND trim(h) <> '') AS kept FROM y GROUP BY user_id""")
def evidence_counts(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").select("user_id", F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("d"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_type")).alias("h"))
    return matching.evidence(e, "user_id", "d", "h", "2024-01-15")[1]


# ------------------------------------------------------------------ social topics

WORDS = "merger chips keynote margin supply tariff launch guidance demand antitrust recall dividend".split()


@query()
def social_admission(spark: SparkSession, base: str) -> DataFrame:
    """Events as topics: a run every six hours, users as tickers; titles, heats, posts and citations by the id."""
    i = F.col("event_id")
    word = lambda c: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (c % len(WORDS)).cast("int") + 1)
    url = lambda k: F.concat(F.lit("https://x.com/a/status/"), (i * 10 + k).cast("string"))
    post = lambda k: F.struct(F.when((i + k) % 29 > 0, F.concat(F.lit("@u"), k.cast("string"))).alias("handle"), url(k).alias("url"), F.when(k % 2 == 0, "Bull").otherwise("bear").alias("stance"), F.lit("says so").alias("claim"), F.when(k == 1, "null").otherwise("3 likes").alias("engagement"))
    posts = F.transform(F.sequence(F.lit(0), (i % 8).cast("int")), post)
    e = table(spark, base, "events")
    topics = e.select(
        i.alias("id"), F.timestamp_micros(F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(21_600_000_000))).alias("at"), F.col("user_id").alias("pos"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), i.alias("n"),
        F.when(i % 37 > 0, F.concat_ws(" ", word(i), word(F.floor(i / 5)), word(F.floor(i / 25)), F.concat(F.lit("t"), (i % 83).cast("string")))).alias("title"), F.lit("s").alias("summary"), F.lit("up").alias("bull"), F.when(i % 41 > 0, "down").alias("bear"),
        F.when(i % 43 == 0, "hot").otherwise((i % 7).cast("string")).alias("heat"), F.when(i % 31 > 0, posts).alias("posts"), F.transform(F.sequence(F.lit(0), (i % 11).cast("int")), url).alias("citations"),
    )
    return social.admitted(topics)
