"""Hits, pairs and slates: what retrieval found, joined with what is known, filtered and put in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.fixed_values import BRIEF_HOURS, EXPLICIT_TICKER, LOCKED_CONFIDENCE, MACRO_CLASSES, OTC_PINK, RELATIONS, SLATE_ALIAS, SLATE_BODY, SLATE_SIZE
from tidewire.functions import values
from tidewire.functions.text import loose_form


def resolved_in_either(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, first_key: str, second_key: str, name: str = "resolved") -> DataFrame:
    """The rows with the key where one of two registries has it, else null. Registries may repeat a key; a row stays one row."""
    known = first.select(F.col(first_key).alias("__known")).unionByName(second.select(F.col(second_key).alias("__known"))).distinct()
    return rows.join(known, F.col(key) == F.col("__known"), "left").withColumnRenamed("__known", name)


def described_hits(hits: DataFrame, item: str, metadata: DataFrame, excluded: DataFrame, order: list[Column]) -> DataFrame:
    """Hits that a cut has left, with what is known of their items, without excluded items: fewer than the cut may be left. ``position`` is
    the place among what is left of each query, in the order of the hits."""
    told = hits.join(metadata, item, "left").join(excluded.select(item), item, "left_anti")
    return told.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def matchable(pairs: DataFrame, own: Column, other: Column, keys: list[str], links: DataFrame, confidence: str, least: float = LOCKED_CONFIDENCE) -> DataFrame:
    """Pairs whose symbols meet (a side without symbols meets any) and that no link of ``least`` confidence or more has settled already."""
    return pairs.filter(values.overlap(own, other)).join(links.filter(F.col(confidence) >= least).select(*keys), keys, "left_anti")


def judged(verdicts: DataFrame, relation: str, confidence: str, candidate: str, known: str) -> DataFrame:
    """Verdicts as links: the relation if it is one, a confidence in [0, 1], and for what stresses a belief the condition that it names, told loosely;
    unrelated ones are dropped."""
    kind = values.one_of(F.col(relation), RELATIONS, "unrelated")
    sure = values.clamp(F.coalesce(F.col(confidence).try_cast("double"), F.lit(0.0)), 0.0, 1.0)
    form = loose_form(F.col(candidate))
    same = F.try_element_at(F.filter(known, lambda x: loose_form(x) == form), F.lit(1))
    named = F.when((kind == "stresses") & (form != ""), same)
    out = verdicts.withColumns({"__relation": kind, "__confidence": sure, "__named": named}).filter("__relation <> 'unrelated'")
    return out.drop(relation, confidence).withColumnsRenamed({"__relation": relation, "__confidence": confidence, "__named": "matched"})


def shown_symbols(rows: DataFrame, key: str, symbols: str, registry: DataFrame, symbol: str, asset_class: str) -> DataFrame:
    """key and its symbols that are worth showing, in order: known ones that are no macro instruments and no pink sheets."""
    macro = F.coalesce(F.col(asset_class).isin(MACRO_CLASSES), F.lit(False))
    known = registry.filter(~macro & ~F.col(symbol).rlike(OTC_PINK)).select(F.col(symbol).alias("__symbol")).distinct()
    each = rows.select(key, F.posexplode(symbols).alias("pos", "__symbol")).join(known, "__symbol")
    kept = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__symbol"))), lambda x: x["__symbol"]).alias("shown"))
    return rows.select(key).join(kept, key, "left").select(key, F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))


def ticker_slate(members: DataFrame, key: str, order: list[Column], title: Column, body: Column, attached: DataFrame, sectors: DataFrame, registry: DataFrame, seeds: DataFrame, most: int = SLATE_SIZE) -> DataFrame:
    """key, position, symbol, display and aliases of the symbols that a group's story may name, in four tiers: attached ones, tickers
    named in the members, equities whose aliases the members have, and seeds of the group's sectors.

    ``attached``: (key, pos, symbol); ``sectors``: (key, pos, sector); ``registry``: (symbol, aliases, asset_class); ``seeds``: (sector, pos, symbol, aliases).
    A symbol counts in its first tier and only if the registry has it; seeds come in the order of the group's sectors and of the seeds of each,
    and add their phrases to the aliases of a symbol on the slate.
    Texts meet aliases of any number by the words that these begin with.
    """
    known = registry.select(F.upper(F.trim("symbol")).alias("symbol"), F.col("aliases").alias("names"), "asset_class").dropDuplicates(["symbol"])
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("member")
    texts = members.select(key, place, F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, SLATE_BODY)).alias("text"))
    tier = lambda n, df, *at: df.select(key, F.lit(n).alias("tier"), F.struct(*[F.col(c).cast("long") for c in at], *[F.lit(0).cast("long")] * (2 - len(at))).alias("at"), F.upper(F.trim("symbol")).alias("symbol"))
    named = texts.select(key, "member", F.posexplode(F.regexp_extract_all("text", F.lit(EXPLICIT_TICKER), F.lit(1))).alias("pos", "symbol"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    names = known.filter("asset_class = 'equity'").select("symbol", F.explode("names").alias("alias")).filter(F.length("alias") >= SLATE_ALIAS)
    begins = names.withColumn("atom", F.try_element_at(words(F.col("alias")), F.lit(1))).filter("atom IS NOT NULL")
    held = F.rlike("text", F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}])\Q"), F.col("alias"), F.lit(r"\E(?![\p{L}\p{N}])")))
    met = texts.select(key, "member", "text", F.explode(F.array_distinct(words(F.col("text")))).alias("atom")).join(begins, "atom").filter(held)
    found = met.withColumn("pos", F.position(F.lower("alias"), F.lower("text")))
    invited = sectors.withColumnRenamed("pos", "place").join(seeds, "sector")
    ranked = reduce(DataFrame.unionByName, [tier(1, attached, "pos"), tier(2, named, "member", "pos"), tier(3, found, "member", "pos"), tier(4, invited, "place", "pos")])
    ranked = ranked.filter("symbol <> ''").join(known, "symbol")
    first = ranked.groupBy(key, "symbol").agg(F.min(F.struct("tier", "at")).alias("first"), F.first("names").alias("names"))
    slate = first.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("first", "symbol"))).filter(F.col("position") <= most)
    phrases = invited.select(key, F.upper(F.trim("symbol")).alias("symbol"), F.explode("aliases").alias("phrase")).groupBy(key, "symbol").agg(F.collect_set("phrase").alias("phrases"))
    merged = slate.join(phrases, [key, "symbol"], "left").withColumn("aliases", F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.coalesce("phrases", F.array().cast("array<string>")))))
    longest = F.transform(F.array_sort(F.transform("aliases", lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda x: x["a"])
    return merged.withColumn("aliases", longest).filter(F.size("aliases") > 0).select(key, "position", "symbol", F.element_at("aliases", 1).alias("display"), "aliases", F.col("first.tier").alias("tier"))


# ------------------------------------------------------------------ order and single rows


def lanes_by_date(lanes: list[DataFrame], date: str, orders: list[list[Column]], most: int) -> DataFrame:
    """The newest ``most`` rows of several lanes; on a date the first lane's come first, each lane in its own order. Rows without a date come last."""
    kept = [lane.orderBy(F.desc_nulls_last(date), *order).limit(most) for lane, order in zip(lanes, orders, strict=True)]  # no more of a lane can be in the result
    rows = reduce(DataFrame.unionByName, [k.withColumn("lane", F.lit(i)).withColumn("__at", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc_nulls_last(date), *orders[i]))) for i, k in enumerate(kept)])
    return rows.orderBy(F.desc_nulls_last(date), "lane", "__at").limit(most).drop("__at")


def next_id(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the id after the one with the largest number behind ``prefix_``, of three digits at least."""
    number = F.when(F.col(column).startswith(prefix + "_"), F.substring(column, len(prefix) + 2, 18).try_cast("long"))
    following = F.coalesce(F.max(number), F.lit(0)) + 1
    return rows.agg(following.alias("n")).select(F.concat(F.lit(prefix + "_"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(3), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("next_id"))


def latest_if_fresh(rows: DataFrame, order: str, made: str, as_of: Column, hours: float = BRIEF_HOURS) -> DataFrame:
    """The latest row, unless it was made more than ``hours`` before ``as_of``; then none."""
    age = (F.unix_micros(as_of) - F.unix_micros(made)) / 3.6e9
    return rows.orderBy(F.desc(order)).limit(1).filter(F.coalesce(age <= hours, F.lit(True)))


def sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows by the order of a hash of the key and a seed: the same rows each time."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def collapsed(rows: DataFrame, keys: list[str], largest: list[str], created: str) -> DataFrame:
    """Copies of a row under several owners as one: the largest of each value, the first time."""
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in largest], F.min(created).alias(created))


def valid_bars(rows: DataFrame, close: str, at: str, adjusted: str | None = None) -> DataFrame:
    """Bars with a time and a close, adjusted if there is one, that is neither missing nor 0."""
    used = F.col(close) if adjusted is None else F.coalesce(F.nullif(F.col(adjusted), F.lit(0.0)), F.col(close))
    return rows.filter(used.isNotNull() & (used != 0) & F.col(at).isNotNull())


def evidence(rows: DataFrame, key: str, date: str, headline: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a date on or after the cutoff and a headline; and per key how many rows there were and were left after each test."""
    day = F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")
    tested = rows.withColumn("__day", day).withColumns({"__dated": F.col("__day").isNotNull(), "__recent": F.col("__day") >= F.lit(cutoff).cast("date"), "__named": F.trim(F.coalesce(headline, F.lit(""))) != ""})
    recent = F.coalesce(F.col("__dated") & F.col("__recent"), F.lit(False))
    counts = tested.groupBy(key).agg(F.count("*").alias("found"), F.count_if("__dated").alias("dated"), F.count_if(recent).alias("recent"), F.count_if(recent & F.col("__named")).alias("kept"))
    return tested.filter(recent & F.col("__named")).drop("__day", "__dated", "__recent", "__named"), counts
