"""Scores of beliefs and feeds: decay, tailwind, composites, bands, ranking. Times are always compared with an ``as_of`` that is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.fixed_values import FEED, FEED_HOURS, FEED_LABELS_OUT, HALF_LIFE_HOURS, PRESCRIPTIONS
from tidewire.functions.values import band, clamp, decay, half_even


def freshness(last_support: Column, horizon_days: Column, as_of: Column) -> Column:
    """0 to 100, halved every half horizon since the last support; 0 without one, a future one counts as now."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(last_support)) / 8.64e10)
    return F.when(last_support.isNull(), F.lit(0)).otherwise(half_even(F.lit(100.0) * decay(age, horizon_days / 2)).cast("int"))


def tailwind_part(direction: Column, return_pct: Column) -> Column:
    """50, up or down to 50 more by the return in the direction held, at 10 percent in full; null without a return."""
    signed = F.when(direction == "long", return_pct).when(direction == "short", -return_pct)
    return half_even(F.lit(50.0) + F.lit(50.0) * clamp(signed / 10, -1, 1))


def tailwind(rows: DataFrame, key: str, direction: str, return_pct: str) -> DataFrame:
    return rows.groupBy(key).agg(half_even(F.avg(F.when(F.col(return_pct).isNotNull(), tailwind_part(F.col(direction), F.col(return_pct))))).cast("int").alias("tailwind"))


def composite(fresh: Column, tail: Column, prior: Column) -> Column:
    """The mean of freshness and tailwind; without one now the earlier tailwind counts, without either freshness alone."""
    wind = F.coalesce(tail, prior)
    return F.when(wind.isNotNull(), half_even((fresh + wind) / 2).cast("int")).otherwise(fresh)


def trend_band(delta: Column) -> Column:
    return F.when(delta >= 3, "up").when(delta <= -3, "down").otherwise("flat")


def trend_of(score: Column, before: Column, status: Column) -> Column:
    """Where a thesis is going: a stressed one is that, else three points up or down make a trend."""
    delta = score - before
    return F.when(status == "stressed", "stressed").when(delta >= 3, "strengthening").when(delta <= -3, "weakening").otherwise("stable")


def signal_of(score: Column) -> Column:
    return F.when(score.isNull(), "medium").otherwise(band(score, [(75, "high"), (60, "medium")], "low"))


def chip(relation: Column, confidence: Column) -> Column:
    """What a card's chip says of a link; null below 0.70 or for other relations."""
    return F.when(confidence >= 0.70, F.when(relation == "supports", "Supports").when(relation == "stresses", "Stresses"))


def prescription(score: Column, status: Column, relation: Column) -> Column:
    """What a thesis' card advises, by its status, its score and the relation of its latest signal; null for a resolved one."""
    stresses = F.coalesce(relation == "stresses", F.lit(False))
    says = {k: F.lit(v) for k, v in PRESCRIPTIONS.items()}
    weak = F.coalesce(status == "stressed", F.lit(False)) | score.isNull() | (score <= 34)
    live = F.when(weak, says["review"]).when(score >= 70, F.when(stresses, says["challenged"]).otherwise(says["holding"])).when(stresses, says["trending"]).otherwise(says["watch"])
    return F.when(F.coalesce(status != "resolved", F.lit(True)), live)


def in_feed(kind: Column, age_hours: Column, label: Column) -> Column:
    """Whether an item is a candidate: a story for 72 hours unless its label says that it is of no use, a social item for 48. Without a kind it is a story."""
    own = F.coalesce(kind, F.lit("story"))
    story = (own == "story") & (age_hours <= FEED_HOURS["story"]) & ~F.coalesce(label.isin(FEED_LABELS_OUT), F.lit(False))
    return F.coalesce(story | ((own == "x") & (age_hours <= FEED_HOURS["x"])), F.lit(False))


def signal_band(score: Column) -> Column:
    return band(score, [(75, "strong"), (60, "building")], "quiet")


def confidence_tier(confidence: Column) -> Column:
    return band(confidence, [(0.85, "high"), (0.75, "medium")], "low")


def feed_score(kind: Column, age_hours: Column, publishers: Column, heat: Column, trend_rank: Column, judged: Column, ticker_hits: Column, sector_hits: Column) -> Column:
    """(base + trend + affinity) x freshness of a story or social item, its age in whole hours."""
    story = kind == "story"
    base = F.when(story, FEED["story_base"] + FEED["per_publisher"] * F.least(publishers, F.lit(FEED["publisher_cap"]))).otherwise(FEED["x_base"] + FEED["per_heat"] * heat)
    trend = F.coalesce(FEED["trend"] * F.greatest(F.lit(0.0), 1 - (trend_rank - 1) / FEED["trend_span"]), F.lit(0.0))
    hit = lambda n: F.least(n, F.lit(FEED["hit_cap"]))
    affinity = F.least(F.lit(FEED["affinity_cap"]), F.when(judged, FEED["judged"]).otherwise(0.0) + FEED["ticker"] * hit(ticker_hits) + FEED["sector"] * hit(sector_hits))
    life = F.when(story, HALF_LIFE_HOURS["story"]).otherwise(HALF_LIFE_HOURS["x"])
    return (base + trend + affinity) * decay(F.floor(F.greatest(F.lit(0.0), age_hours)), life)


def brief_score(days: Column, boost: Column, links: Column) -> Column:
    return F.lit(-10.0) * days + F.coalesce(boost, F.lit(0.0)) + F.lit(0.01) * F.coalesce(links, F.lit(0))


def stale_status(status: Column, links: Column, age_days: Column, stale_after: float) -> Column:
    """A candidate with a link becomes active, one without for too long is rejected; others stay as they are."""
    return F.when(status != "candidate", status).when(links >= 1, "active").when(age_days > stale_after, "rejected").otherwise(status)


def presented_at(published: Column, created: Column, as_of: Column, hours: float = 6.0) -> Column:
    """Of a group's rows (as aggregates): the latest publish time, or the latest creation where no row has one, if at most six hours
    old; else now."""
    latest = F.coalesce(F.max(published), F.max(created))
    age = (F.unix_micros(as_of) - F.unix_micros(latest)) / 3.6e9
    return F.when((age >= 0) & (age <= hours), latest).otherwise(as_of)
