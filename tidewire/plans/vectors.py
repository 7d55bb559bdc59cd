"""Retrieval over embeddings, centroids, pruning, and the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import retrieval, scoring, sequential, vector_index
from tidewire.plans.catalogue import query
from tidewire.plans.round_trips import there_and_back
from tidewire.sources.tables import table

QUERIES_SQL = "q AS (SELECT vec_id AS qid, label AS qlabel, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT qid, qlabel, vec_id, label, list_cosine_similarity(qe, embedding::DOUBLE[]) AS cosine FROM q, embeddings WHERE embedding IS NOT NULL)"


def asking(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and those whose id is divisible by 100 as queries against all."""
    v = table(spark, base, "embeddings")
    return v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel"), F.col("embedding").alias("qe"))


@query(f"WITH {QUERIES_SQL}, r AS (SELECT qid AS query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS INT) AS rank FROM c) SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 10 AND cosine >= 0.1")
def cosine_top_k(spark: SparkSession, base: str) -> DataFrame:
    v, q = asking(spark, base)
    return retrieval.cosine_top_k(v, "vec_id", "embedding", q, "qid", "qe", 10, 0.1).withColumn("cosine", F.round("cosine", 6)).select("query_id", "vec_id", "cosine", "rank")


@query(f"WITH {QUERIES_SQL}, r AS (SELECT qid AS query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS INT) AS rank FROM c) SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 10")
def indexed_top_k(spark: SparkSession, base: str) -> DataFrame:
    """The ten best rows of each query by an index that is built, opened again, searched by bounds and deleted."""

    def work(folder: str) -> DataFrame:
        v, q = asking(spark, base)
        vector_index.VectorIndex.build(v, "vec_id", "embedding", f"{folder}/index", cells=32)
        return vector_index.VectorIndex(spark, f"{folder}/index").exact(q, "qid", "qe", 10, probes=4)

    found = there_and_back(spark, work)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank")


@query(f"WITH {QUERIES_SQL}, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY cosine DESC, vec_id) = 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, label) AS INT) AS rank FROM b) SELECT qid AS query_id, label, vec_id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 5")
def best_chunk_per_label(spark: SparkSession, base: str) -> DataFrame:
    v, q = asking(spark, base)
    return retrieval.best_per_parent(v, "vec_id", "embedding", "label", q, "qid", "qe", 5).withColumn("cosine", F.round("cosine", 6)).select("query_id", "label", "vec_id", "cosine", "rank")


@query(f"WITH {QUERIES_SQL}, n AS (SELECT * FROM c WHERE cosine >= 0.05 AND vec_id IN (SELECT p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) <= 20), r AS (SELECT n.*, p_retailprice AS volume, CAST(row_number() OVER (PARTITION BY qid ORDER BY p_retailprice DESC, cosine DESC, vec_id) AS INT) AS rank FROM n JOIN part ON p_partkey = vec_id) SELECT qid AS query_id, vec_id, round(cosine, 6) AS cosine, volume, rank FROM r WHERE rank <= 5")
def two_stage_top_k(spark: SparkSession, base: str) -> DataFrame:
    v, q = asking(spark, base)
    rows = v.join(table(spark, base, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_retailprice").alias("volume")), "vec_id")
    return retrieval.two_stage_top_k(rows, "vec_id", "embedding", "volume", q, "qid", "qe", 5, 0.05).withColumn("cosine", F.round("cosine", 6)).select("query_id", "vec_id", "cosine", "volume", "rank")


@query(f"WITH {QUERIES_SQL}, h AS (SELECT * FROM c WHERE vec_id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) <= 15), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY qlabel, vec_id ORDER BY cosine DESC, qid) = 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qlabel ORDER BY cosine DESC, vec_id) AS INT) AS rank FROM o) SELECT qlabel, vec_id, qid AS query_id, round(cosine, 6) AS cosine, rank FROM r WHERE rank <= 20")
def multi_query_candidates(spark: SparkSession, base: str) -> DataFrame:
    v, q = asking(spark, base)
    return retrieval.multi_query(v, "vec_id", "embedding", q, "qid", "qe", "qlabel", 15, 20).withColumn("cosine", F.round("cosine", 6)).select("qlabel", "vec_id", "query_id", "cosine", "rank")


@query(f"WITH {QUERIES_SQL} SELECT qlabel, label, qid AS query_id, vec_id, round(cosine, 6) AS cosine, CASE WHEN cosine >= 0.88 THEN 'duplicate' WHEN cosine >= 0.80 THEN 'rerank' ELSE 'new' END AS band FROM c WHERE qlabel <> label QUALIFY row_number() OVER (PARTITION BY qlabel, label ORDER BY cosine DESC, qid, vec_id) = 1")
def related_pairs(spark: SparkSession, base: str) -> DataFrame:
    """For the beliefs (labels) of the queries and every other belief, the best pair of chunks."""
    v, q = asking(spark, base)
    found = retrieval.cosine_candidates(v, "vec_id", "embedding", q, "qid", "qe", 1, parent="label")
    owned = found.join(q.select(F.col("qid").alias("query_id"), "qlabel"), "query_id").filter("qlabel <> label")
    best = retrieval.top_k(owned, ["qlabel", "label"], [F.desc("cosine"), "query_id", "vec_id"], 1)
    return best.select("qlabel", "label", "query_id", "vec_id", F.round("cosine", 6).alias("cosine"), retrieval.duplicate_band(F.col("cosine")).alias("band"))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY ALL), z AS (SELECT label, sqrt(sum(x * x)) AS z FROM m GROUP BY label), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT m.label, n, CAST(pos - 1 AS INT) AS pos, round(x / z, 6) AS x FROM m JOIN z ON z.label = m.label JOIN n ON n.label = m.label""")
def centroids(spark: SparkSession, base: str) -> DataFrame:
    c = retrieval.centroids(table(spark, base, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query()
def coherence_prune(spark: SparkSession, base: str) -> DataFrame:
    """Groups of four neighbouring vectors, without members that are far from all others."""
    v = table(spark, base, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("grp"), "vec_id", "embedding")
    return sequential.coherence_prune(v, "grp", "vec_id", "vec_id", "embedding")


# ------------------------------------------------------------------ feed and brief

FEED_SQL = """a AS (SELECT max(ts) AS now FROM events), f AS (SELECT event_id, user_id, ts, event_type IN ('view', 'click') AS story, floor(epoch(now - ts) / 3600) AS age, event_id % 6 AS pubs, 1 + event_id % 5 AS heat, CASE WHEN event_id % 3 = 0 THEN 1 + event_id % 80 END AS tr, event_id % 4 = 0 AS judged, event_id % 3 AS th, event_id % 2 AS sh FROM events, a),
s AS (SELECT event_id, (CASE WHEN story THEN 0.45 + 0.05 * least(pubs, 4) ELSE 0.25 + 0.09 * heat END + coalesce(0.25 * greatest(0, 1 - (tr - 1) / 60.0), 0) + least(0.45, CASE WHEN judged THEN 0.35 ELSE 0 END + 0.25 * least(th, 2) + 0.10 * least(sh, 2))) * power(0.5, age / CASE WHEN story THEN 14.0 ELSE 32.0 END) AS score FROM f)"""


def _feed(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    at = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    i = F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "click"), "story").otherwise("x")
    score = scoring.feed_score(kind, (F.unix_micros("now") - F.unix_micros("ts")) / 3.6e9, i % 6, 1 + i % 5, F.when(i % 3 == 0, 1 + i % 80), i % 4 == 0, i % 3, i % 2)
    return at.select("event_id", "user_id", "ts", (kind == "x").alias("social"), score.alias("score"), F.when(i % 5 > 0, F.concat(F.lit("T"), (i % 5).cast("string"))).alias("lead"))


@query(f"WITH {FEED_SQL} SELECT event_id, round(score, 8) AS score FROM s")
def feed_score(spark: SparkSession, base: str) -> DataFrame:
    return _feed(spark, base).select("event_id", F.round("score", 8).alias("score"))


@query()
def feed_compose(spark: SparkSession, base: str) -> DataFrame:
    return sequential.feed_compose(_feed(spark, base), "user_id", "event_id", "score", "ts", "lead", "social")


@query("""WITH k AS (SELECT doc_id, count(*) AS links FROM labels WHERE quality = 1 GROUP BY doc_id) SELECT d.doc_id, round(-10.0::DOUBLE * (d.doc_id % 9) + CASE WHEN lang = 'en' THEN 3 WHEN lang = 'de' THEN 1 ELSE 0 END + 0.01::DOUBLE * coalesce(links, 0), 6) AS score FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id ORDER BY score DESC, d.doc_id LIMIT 15""")
def brief_rank(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").select("doc_id", "lang")
    links = table(spark, base, "labels").filter("quality = 1").groupBy("doc_id").agg(F.count("*").alias("links"))
    boost = F.when(F.col("lang") == "en", 3.0).when(F.col("lang") == "de", 1.0)
    return d.join(links, "doc_id", "left").select("doc_id", F.round(scoring.brief_score(F.col("doc_id") % 9, boost, F.col("links")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(15)
