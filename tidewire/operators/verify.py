"""Checks of composed texts against their evidence: citations, quotes, tickers; citation resolution; provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import ascii_words, quote_form

TICKER = r"^[A-Z0-9][A-Z0-9.\-=^]{0,11}$"


def verify_quotes(quotes: DataFrame, members: DataFrame, story: str) -> DataFrame:
    """story, pos and ``found`` of every quote: whether a cited member's body has its text, or every fragment of 12 or more characters
    between ellipses. ``quotes`` has pos, text and source_doc_ids; ``members`` has news_id and body."""
    asked = quotes.select(story, "pos", quote_form(F.col("text")).alias("__q"), F.explode_outer("source_doc_ids").alias("news_id"))
    bodies = members.select(story, "news_id", quote_form(F.col("body")).alias("__b"))
    parts = F.filter(F.transform(F.split("__q", r"\.\.\."), lambda x: F.trim(x)), lambda x: F.length(x) >= 12)
    whole = F.col("__b").contains(F.col("__q"))
    pieces = (F.size(parts) > 0) & F.forall(parts, lambda x: F.col("__b").contains(x))
    met = asked.join(bodies, [story, "news_id"], "left").withColumn("__ok", F.coalesce(whole | pieces, F.lit(False)))
    return met.groupBy(story, "pos").agg(F.bool_or("__ok").alias("found"))


def verify_payload(payloads: DataFrame, members: DataFrame, story: str, allowed: DataFrame | None = None) -> DataFrame:
    """story, ok, errors and quote_scrub_indices of every payload.

    ``payloads`` has claims and overview (arrays of text and source_doc_ids), quotes (text, speaker, source_doc_ids) and tickers (symbol,
    source_doc_id, evidence_span). Citations outside the members, quotes without a speaker or citation, malformed symbols, spans that their
    document lacks and, with ``allowed`` (story, symbol), symbols off the slate are errors; quotes that no cited body has are only to be scrubbed.
    """
    refs = []
    for part in ("overview", "claims", "quotes"):
        refs.append(payloads.select(story, F.lit(part).alias("part"), F.posexplode(part).alias("pos", "x")).select(story, "part", "pos", F.col("x.source_doc_ids").alias("ids")))
    every = refs[0].unionByName(refs[1]).unionByName(refs[2])
    empty = every.filter(F.size(F.coalesce("ids", F.array().cast("array<string>"))) == 0).select(story, F.format_string("%s[%d]: no citation", "part", "pos").alias("error"))
    known = members.select(story, F.col("news_id").alias("id")).distinct()
    foreign = every.select(story, "part", "pos", F.explode("ids").alias("id")).join(known, [story, "id"], "left_anti").select(story, F.format_string("%s[%d]: %s is no member", "part", "pos", "id").alias("error"))
    quotes = payloads.select(story, F.posexplode("quotes").alias("pos", "x")).select(story, "pos", "x.*")
    mute = quotes.filter(F.trim(F.coalesce("speaker", F.lit(""))) == "").select(story, F.format_string("quotes[%d]: no speaker", "pos").alias("error"))
    tickers = payloads.select(story, F.posexplode("tickers").alias("pos", "x")).select(story, "pos", "x.*")
    shape = tickers.filter(~F.coalesce(F.col("symbol").rlike(TICKER), F.lit(False))).select(story, F.format_string("tickers[%d]: malformed symbol", "pos").alias("error"))
    bodies = members.select(story, F.col("news_id").alias("source_doc_id"), F.lower("body").alias("__b"))
    span = tickers.join(bodies, [story, "source_doc_id"], "left").filter(~F.coalesce(F.instr(F.col("__b"), F.lower("evidence_span")) > 0, F.lit(False))).select(story, F.format_string("tickers[%d]: evidence is not in its document", "pos").alias("error"))
    errors = empty.unionByName(foreign).unionByName(mute).unionByName(shape).unionByName(span)
    if allowed is not None:
        errors = errors.unionByName(tickers.join(allowed.select(story, "symbol").distinct(), [story, "symbol"], "left_anti").select(story, F.format_string("tickers[%d]: %s is off the slate", "pos", "symbol").alias("error")))
    by_story = errors.groupBy(story).agg(F.array_sort(F.collect_set("error")).alias("errors"))
    scrub = verify_quotes(quotes, members, story).filter("NOT found").groupBy(story).agg(F.array_sort(F.collect_list("pos")).alias("scrub"))
    out = payloads.select(story).join(by_story, story, "left").join(scrub, story, "left")
    return out.select(story, F.col("errors").isNull().alias("ok"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), F.coalesce("scrub", F.array().cast("array<int>")).alias("quote_scrub_indices"))


def resolve_citations(refs: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """A row for each reference with its position from 1: kept, or dropped with a reason (blank, repeated, unknown)."""
    rows = refs.select(key, F.posexplode(ids).alias("__p", "ref")).withColumn("position", F.col("__p") + 1)
    again = F.row_number().over(Window.partitionBy(key, "ref").orderBy("position")) > 1
    found = rows.withColumn("__again", again).join(known.select(F.col(known_id).alias("ref"), F.lit(True).alias("__known")).distinct(), "ref", "left")
    reason = F.when(F.col("ref").isNull() | (F.trim(F.col("ref").cast("string")) == ""), "blank").when(F.col("__known").isNull(), "unknown").when(F.col("__again"), "repeated")
    return found.select(key, "position", "ref", reason.isNull().alias("kept"), reason.alias("reason"))


def in_requested_order(requested: DataFrame, key: str, names: str, data: DataFrame, name: str, values: list[str]) -> DataFrame:
    """A row for each requested name in its order, with the data or the note ``no data``."""
    rows = requested.select(key, F.posexplode(names).alias("position", name))
    joined = rows.join(data.select(name, *values, F.lit(True).alias("__has")), name, "left")
    return joined.select(key, "position", name, *values, F.when(F.col("__has").isNull(), "no data").alias("note"))


def has_datapoint(text: Column) -> Column:
    return text.rlike(ascii_words(r"\d+(?:\.\d+)?\s?(?:%|bps|bn|m|k|x)?\b"))


def provenance(briefs: DataFrame, key: str, items: str, known: DataFrame, known_id: str) -> DataFrame:
    """key, position and issue of every item of a brief that has no source, an unknown source, no text, or no number.

    Items have ``text`` and ``source_ids``.
    """
    rows = briefs.select(key, F.posexplode(items).alias("position", "x")).select(key, "position", F.col("x.text").alias("text"), F.coalesce("x.source_ids", F.array().cast("array<bigint>")).alias("ids"))
    plain = rows.select(key, "position", F.explode(F.array_compact(F.array(F.when(F.size("ids") == 0, "no_source"), F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text"), F.when(~F.coalesce(has_datapoint(F.col("text")), F.lit(False)), "no_number")))).alias("issue"))
    unknown = rows.select(key, "position", F.explode("ids").alias("id")).join(known.select(F.col(known_id).alias("id")).distinct(), "id", "left_anti").select(key, "position", F.lit("unknown_source").alias("issue")).distinct()
    return plain.unionByName(unknown)
