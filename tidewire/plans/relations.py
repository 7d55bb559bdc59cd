"""Joins, set-based ranking, merges and citations on the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import usd_short as usd_text
from tidewire.operators import health, relational, verify
from tidewire.plans.catalogue import query
from tidewire.sources.tables import table


@query("""
WITH latest AS (SELECT max(o_orderdate) AS d FROM orders), hot AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey, latest WHERE o_orderdate >= d - INTERVAL 30 DAY),
owned AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
s AS (SELECT c.c_custkey, count(DISTINCT o_orderkey) AS supports, max(CASE WHEN h.l_partkey IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN hot h ON h.l_partkey = l.l_partkey WHERE c.c_custkey NOT IN (SELECT o_custkey FROM owned) GROUP BY c.c_custkey)
SELECT c_custkey, supports, hit, supports + 2 * hit AS blend FROM s ORDER BY blend DESC, c_custkey LIMIT 25
""")
def discover_rank(spark: SparkSession, base: str) -> DataFrame:
    o, li, c = table(spark, base, "orders"), table(spark, base, "lineitem").select("l_orderkey", "l_partkey"), table(spark, base, "customer").select("c_custkey")
    latest = F.broadcast(o.agg(F.max("o_orderdate").alias("d")))  # one row
    recent = o.join(latest).filter(F.col("o_orderdate") >= F.col("d") - F.expr("INTERVAL 30 DAYS")).select("o_orderkey")
    hot = li.join(recent, li["l_orderkey"] == recent["o_orderkey"], "left_semi").select("l_partkey").distinct().withColumn("hot", F.lit(1))
    owned = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    free = c.join(owned, "c_custkey", "left_anti")
    lines = free.join(o.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    scored = lines.join(hot, "l_partkey", "left").groupBy("c_custkey", "o_orderkey").agg(F.coalesce(F.max("hot"), F.lit(0)).alias("hit")).groupBy("c_custkey").agg(F.count("*").alias("supports"), F.max("hit").alias("hit"))
    return scored.withColumn("blend", F.col("supports") + 2 * F.col("hit")).orderBy(F.desc("blend"), "c_custkey").limit(25)


@query("""
WITH n AS (SELECT max(o_orderdate) AS now FROM orders), s AS (SELECT o_custkey, count(*) FILTER (o_orderdate >= now - INTERVAL 90 DAY) AS fresh, max(o_totalprice) FILTER (o_orderstatus = 'F') AS score FROM orders, n GROUP BY o_custkey)
SELECT c_custkey, coalesce(fresh, 0) AS fresh, score FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
ORDER BY CASE WHEN coalesce(fresh, 0) > 0 THEN 0 ELSE 1 END, score DESC NULLS LAST, c_custkey LIMIT 30
""")
def tracked_rank(spark: SparkSession, base: str) -> DataFrame:
    o, c = table(spark, base, "orders"), table(spark, base, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")
    now = F.broadcast(o.agg(F.max("o_orderdate").alias("now")))  # one row
    s = o.join(now).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderdate") >= F.col("now") - F.expr("INTERVAL 90 DAYS")).alias("fresh"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("score"))
    return c.join(s, "c_custkey", "left").select("c_custkey", F.coalesce("fresh", F.lit(0)).alias("fresh"), "score").orderBy(F.when(F.col("fresh") > 0, 0).otherwise(1), F.desc_nulls_last("score"), "c_custkey").limit(30)


@query("""
WITH mine AS (SELECT DISTINCT p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 1), b AS (SELECT o_custkey, count(DISTINCT p_brand) AS overlap FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
  WHERE p_brand IN (SELECT p_brand FROM mine) AND o_custkey <> 1 GROUP BY o_custkey)
SELECT o_custkey, overlap FROM b ORDER BY overlap DESC, o_custkey LIMIT 10
""")
def recommended_rank(spark: SparkSession, base: str) -> DataFrame:
    o, li, p = table(spark, base, "orders").select("o_orderkey", "o_custkey"), table(spark, base, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")), table(spark, base, "part").select("p_partkey", "p_brand")
    held = o.join(li, "o_orderkey").join(p, "p_partkey").select("o_custkey", "p_brand")
    mine = held.filter("o_custkey = 1").select("p_brand").distinct()
    return held.filter("o_custkey <> 1").join(mine, "p_brand", "left_semi").groupBy("o_custkey").agg(F.countDistinct("p_brand").alias("overlap")).orderBy(F.desc("overlap"), "o_custkey").limit(10)


@query("""
WITH c AS (SELECT coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'unlabeled') AS label, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 0 GROUP BY 1)
SELECT label, n, (SELECT round(coalesce(sum(n) FILTER (label = 'good'), 0) / sum(n) FILTER (label <> 'unlabeled'), 3) FROM c) AS good_rate FROM c
""")
def quality_window(spark: SparkSession, base: str) -> DataFrame:
    marks = table(spark, base, "labels").withColumn("label", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"))
    return health.labelled_rate(table(spark, base, "documents").select("doc_id"), marks, "doc_id", "label", "good", F.col("toxic") == 0)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unjudged_docs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id").join(table(spark, base, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1) AND n_chars > 0")
def visible_docs(spark: SparkSession, base: str) -> DataFrame:
    hidden = table(spark, base, "labels").filter("quality = 0 OR toxic = 1").select("doc_id")
    return table(spark, base, "documents").filter("n_chars > 0").select("doc_id", "source").join(hidden, "doc_id", "left_anti")


@query("SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def live_entities(spark: SparkSession, base: str) -> DataFrame:
    """A semi join that is one of two conditions: the distinct keys come in as a flag."""
    big = table(spark, base, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("big", F.lit(True))
    return table(spark, base, "customer").select("c_custkey", "c_acctbal").join(big, "c_custkey", "left").filter("c_acctbal < 0 OR big").select("c_custkey")


@query("""
WITH m AS (SELECT l_orderkey, count(*) AS members FROM lineitem GROUP BY l_orderkey), tried AS (SELECT l_orderkey, max(l_linenumber)::BIGINT AS members, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT m.l_orderkey, m.members FROM m LEFT JOIN tried t ON t.l_orderkey = m.l_orderkey AND t.members = m.members AND t.n >= 2 WHERE t.l_orderkey IS NULL ORDER BY m.members DESC, m.l_orderkey LIMIT 1200
""")
def stuck_candidates(spark: SparkSession, base: str) -> DataFrame:
    li = table(spark, base, "lineitem")
    m = li.groupBy("l_orderkey").agg(F.count("*").alias("members"))
    tried = li.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("bigint").alias("members"), F.count("*").alias("n")).filter("n >= 2")
    return m.join(tried, ["l_orderkey", "members"], "left_anti").orderBy(F.desc("members"), "l_orderkey").limit(1200)


@query("SELECT o_orderkey, CASE WHEN abs(x) >= 1e9 THEN '$' || printf('%.2f', x / 1e9) || 'B' WHEN abs(x) >= 1e6 THEN '$' || printf('%.2f', x / 1e6) || 'M' WHEN abs(x) >= 1e3 THEN '$' || printf('%.1f', x / 1e3) || 'K' ELSE '$' || printf('%.2f', x) END AS price FROM (SELECT o_orderkey, o_orderkey % 7 * 8388608.0 AS x FROM orders)")
def usd_short(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "orders").select("o_orderkey", usd_text((F.col("o_orderkey") % 7 * 8388608.0).cast("double")).alias("price"))


@query("""
WITH t AS (SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS worth FROM part GROUP BY p_brand)
SELECT p_brand, n, worth, CASE WHEN n >= 85 THEN 'bundle' WHEN n >= 70 THEN 'solo' ELSE 'skip' END AS verdict FROM t ORDER BY n DESC, p_brand
""")
def theme_bundles(spark: SparkSession, base: str) -> DataFrame:
    t = table(spark, base, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("worth"))
    return t.withColumn("verdict", F.when(F.col("n") >= 85, "bundle").when(F.col("n") >= 70, "solo").otherwise("skip")).orderBy(F.desc("n"), "p_brand")


REFS = "r AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS position, l_partkey AS ref FROM lineitem)"


@query(f"""WITH {REFS}, k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, ref ORDER BY position) AS again FROM r)
SELECT l_orderkey, position, ref, p_partkey IS NOT NULL AND again = 1 AS kept, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN again > 1 THEN 'repeated' END AS reason FROM k LEFT JOIN part ON p_partkey = ref AND p_size > 10""")
def citation_resolution(spark: SparkSession, base: str) -> DataFrame:
    refs = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("refs"))
    return verify.resolve_citations(refs, "l_orderkey", "refs", table(spark, base, "part").filter("p_size > 10"), "p_partkey")


@query(f"WITH {REFS} SELECT l_orderkey, position - 1 AS position, ref AS p_partkey, p_name, CASE WHEN p_partkey IS NULL THEN 'no data' END AS note FROM r LEFT JOIN part ON p_partkey = ref AND p_size > 10")
def requested_order(spark: SparkSession, base: str) -> DataFrame:
    asked = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"]).alias("names"))
    return verify.in_requested_order(asked, "l_orderkey", "names", table(spark, base, "part").filter("p_size > 10"), "p_partkey", ["p_name"])


# ------------------------------------------------------------------ merges: even keys are the table, keys that 3 divides come in


def _halves(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, base, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND NOT (o_orderkey % 2 = 0 AND o_orderstatus = 'F') THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_sticky(spark: SparkSession, base: str) -> DataFrame:
    old, new = _halves(spark, base)
    return relational.upsert_sticky(old, new, ["o_orderkey"], "o_orderstatus", "F")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def replace_by_pk(spark: SparkSession, base: str) -> DataFrame:
    old, new = _halves(spark, base)
    return relational.replace_by_key(old, new, ["o_orderkey"], [F.desc("o_totalprice")])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'N' END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def insert_ignore(spark: SparkSession, base: str) -> DataFrame:
    old, new = _halves(spark, base)
    return relational.insert_ignore(old, new, ["o_orderkey"], [F.col("o_totalprice")])


@query("SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen, count(*) AS seen_count FROM orders GROUP BY o_custkey")
def upsert_counter(spark: SparkSession, base: str) -> DataFrame:
    """Two batches, one after the other: the result is that of both at once."""
    o = table(spark, base, "orders")
    empty = o.limit(0).select("o_custkey", F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_seen"), F.lit(0).cast("bigint").alias("seen_count"))
    first = relational.upsert_counter(empty, o.filter("o_orderkey % 2 = 0"), ["o_custkey"], "o_orderdate")
    both = relational.upsert_counter(first, o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderdate")
    return both.select("o_custkey", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "seen_count")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' OR o_orderkey % 3 = 0")
def delete_not_in(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders").select("o_orderkey", "o_orderstatus")
    return relational.delete_not_in(o, o.filter("o_orderkey % 3 = 0"), ["o_orderkey"], F.col("o_orderstatus") == "O")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def coalesce_merge(spark: SparkSession, base: str) -> DataFrame:
    old, new = _halves(spark, base)
    return relational.coalesce_merge(old, new.withColumn("o_orderstatus", F.lit(None).cast("string")), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    kept = table(spark, base, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relational.cascade_delete(table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), kept, "l_orderkey")


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'price' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status' WHEN o_orderpriority LIKE '4%' THEN 'priority' END AS broken FROM orders)
SELECT name, count(broken) AS violations FROM (VALUES ('price'), ('status'), ('priority')) n(name) LEFT JOIN v ON broken = name GROUP BY name""")
def structural_audit(spark: SparkSession, base: str) -> DataFrame:
    return health.audit(table(spark, base, "orders"), [("price", F.col("o_totalprice") > 0), ("status", F.col("o_orderstatus").isin("O", "F")), ("priority", ~F.col("o_orderpriority").startswith("4"))])


@query("SELECT r_name, n_name, round(coalesce(sum(s_acctbal), 0), 2) AS balance, count(s_suppkey) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY ALL")
def region_balances(spark: SparkSession, base: str) -> DataFrame:
    s = table(spark, base, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal")
    n = table(spark, base, "nation").join(table(spark, base, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(s, "n_nationkey", "left").groupBy("r_name", "n_name").agg(F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("balance"), F.count("s_suppkey").alias("suppliers"))


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "customer").select(F.col("c_nationkey").alias("key"))
    return a.intersect(table(spark, base, "supplier").select("s_nationkey")).subtract(table(spark, base, "nation").filter("n_regionkey = 0").select("n_nationkey"))
