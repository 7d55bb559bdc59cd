"""Rule engines as single projections: tag gate, materiality, publishers, routing, funnel."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.fixed_values import (
    ALIASES_DENIED, AUTOPROMOTE_CLASSES, COMMODITY_PROXIES, EXCHANGE_TICKER, GATE_STOPWORDS, HEADLINE_BONUS, HIGH_VALUE, LAWYER_SPAM, MACRO_KEYWORDS, MAINSTREAM_SYMBOLS, NO_MATCH_SCORE, NOISE, PR_WIRE_CAP, PROXY_CLASSES, PUBLISHERS, REASON_ORDER, RELAXED_HOURS, SCHEDULING, SHARP_CLASSES, SINGLE_SOURCE_CLASSES, STRICT_HOURS, SYMBOLS_DENIED, TIER1_MACRO, TIER1_MACRO_FLOOR
)
from tidewire.functions.text import ascii_words


def _hit(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iu){ascii_words(pattern)}")


def folded(c: Column) -> Column:
    """Lower case, with the four characters that match ASCII letters without regard to case as these: what patterns in lower case are
    matched against, at a fraction of the time that flags for case cost. Other characters beyond ASCII are one that is no part of a word."""
    return F.regexp_replace(F.lower(F.translate(c, "ſİıK", "siik")), r"[^\x00-\x7F]", "\u00a7")


def _gates(patterns: list[str], size: int = 10) -> list[tuple[str | None, list[int]]]:
    """Groups of patterns with one pattern that any text matched by one of them matches: the places where a word begins are then looked
    for once a group. Patterns that can't be joined so (alternatives at the top, ends of the text, what must not follow) have None."""

    def joins(p: str) -> bool:
        depth, rest = 0, re.sub(r"\\.|\[[^\]]*\]", "x", p[2:])
        for c in rest:
            depth += (c == "(") - (c == ")")
            if c in "^$" or (c == "|" and not depth):
                return False
        return p.startswith(r"\b") and "(?!" not in p and "(?<" not in p and "(?=" not in p

    able = [k for k, p in enumerate(patterns) if joins(p)]
    groups = [able[k : k + size] for k in range(0, len(able), size)]
    alone = [k for k in range(len(patterns)) if k not in set(able)]
    return [(r"\b(?:" + "|".join(patterns[k][2:] for k in g) + ")", g) for g in groups] + ([(None, alone)] if alone else [])


def _gated(text: Column, patterns: list[str], name: str) -> tuple[Column, list[Column]]:
    """A column ``name`` of which groups of patterns a text can match, and for each pattern whether its group can."""
    gates = _gates(patterns)
    held = F.array(*[F.lit(True) if g is None else text.rlike(g) for g, _ in gates])
    group = {k: n for n, (_, own) in enumerate(gates) for k in own}
    return held, [F.get(F.col(name), F.lit(group[k])) for k in range(len(patterns))]


#: Of a body, so many characters count for its materiality.
EXCERPT_CHARS = 600


def with_materiality(rows: DataFrame, headline: Column, body: Column) -> DataFrame:
    """The rows with a struct ``materiality`` of score and labels of a text, of whose body the first ``EXCERPT_CHARS`` characters count.

    A headline of law firms is 0. Else every pattern that matters adds its weight, and a bonus if the headline alone has it, to 100 at
    most; without any, noise is 0 and nothing at all is 15. A headline that only schedules a report isn't earnings but noise. The labels
    are those of what matters and of noise together.

    Every pattern is matched once, and only if its group's gate holds, into one struct of flags that score and labels are read from. The
    struct is generated (``inline`` of one element), which filters on the score are not pushed through, so they don't match again.
    """
    head, excerpt = F.coalesce(headline, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, EXCERPT_CHARS)
    parts = rows.withColumn("__parts", F.struct(folded(head).alias("head"), folded(excerpt).alias("body"), folded(F.concat(head, F.lit("  ||  "), excerpt)).alias("full")))
    h, x, f = (F.col(f"__parts.{k}") for k in ("head", "body", "full"))
    event_gate, may_be_event = _gated(f, [p for p, _, _ in HIGH_VALUE], "__event_gate")
    noise_gate, may_be_noise = _gated(f, [p for p, _ in NOISE], "__noise_gate")
    parts = parts.withColumns({"__event_gate": event_gate, "__noise_gate": noise_gate})
    events = F.array(*[F.when(may & f.rlike(p), F.when(h.rlike(p), w + HEADLINE_BONUS).otherwise(w)).otherwise(0) for may, (p, w, _) in zip(may_be_event, HIGH_VALUE, strict=True)])
    noise = F.array(*[F.when(may & (h.rlike(p) | x.rlike(p)), 1).otherwise(0) for may, (p, _) in zip(may_be_noise, NOISE, strict=True)])
    found = F.struct(events.alias("__events"), noise.alias("__noise"), h.rlike(LAWYER_SPAM).alias("__spam"), h.rlike(SCHEDULING).alias("__scheduled"))
    flags = parts.select(*[F.col(f"`{c}`") for c in rows.columns], F.inline_outer(F.array(found)))
    label = F.array(*[F.lit(x) for _, _, x in HIGH_VALUE])
    counted = F.filter(F.zip_with("__events", label, lambda w, x: F.struct(w.alias("w"), x.alias("label"))), lambda e: (e["w"] > 0) & ~(F.col("__scheduled") & (e["label"] == "earnings")))
    noted = F.filter(F.zip_with("__noise", F.array(*[F.lit(x) for _, x in NOISE]), lambda n, x: F.when(n > 0, x)), lambda x: x.isNotNull())
    noted = F.when(F.col("__scheduled"), F.concat(noted, F.array(F.lit("earnings_schedule")))).otherwise(noted)
    judged = flags.withColumns({"__counted": counted, "__noted": noted})
    total = F.aggregate("__counted", F.lit(0), lambda t, e: t + e["w"])
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("__counted", lambda e: e["label"]), F.col("__noted"))))
    score = F.when(F.size("__counted") > 0, F.least(F.lit(100), total)).when(F.size("__noted") > 0, 0).otherwise(NO_MATCH_SCORE)
    spam = F.col("__spam")
    out = F.struct(F.when(spam, 0).otherwise(score).cast("int").alias("score"), F.when(spam, F.array(F.lit("lawyer_spam"))).otherwise(labels).alias("labels"))
    return judged.select(*[F.col(f"`{c}`") for c in rows.columns], out.alias("materiality"))


def adjusted(score: Column, labels: Column, headline: Column, kind: Column, tier: Column) -> Column:
    """The score after what the publisher says: press wires are capped, macro headlines of first-tier publishers have a floor."""
    capped = F.when(kind == "pr_wire", F.least(score, F.lit(PR_WIRE_CAP))).otherwise(score)
    macro = (tier == "tier1") & _hit(F.coalesce(headline, F.lit("")), TIER1_MACRO)
    raised = F.coalesce(macro, F.lit(False)) & (capped < TIER1_MACRO_FLOOR)
    return F.struct(F.when(raised, TIER1_MACRO_FLOOR).otherwise(capped).cast("int").alias("score"), F.when(raised, F.array_sort(F.array_distinct(F.concat(labels, F.array(F.lit("tier1_macro_commentary")))))).otherwise(labels).alias("labels"))


# ------------------------------------------------------------------ publishers


def host_of(url: Column) -> Column:
    """Host in lower case without www., m. or mobile."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^(?:www\.|mobile\.|m\.)", "")


def with_publisher(rows: DataFrame, url: str, publishers: list[tuple] = PUBLISHERS) -> DataFrame:
    """The rows with host, publisher, tier, kind, independence and stance of the longest known suffix of the host; else the host stands for itself.

    A row meets the table by the suffixes of its host, an equi-join; the table is a constant.
    """
    spark = rows.sparkSession
    dims = F.broadcast(spark.createDataFrame(publishers, "suffix string, publisher string, tier string, kind string, independence string, stance string"))
    named = rows.withColumn("host", host_of(F.col(url)))
    hosts = named.select("host").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = hosts.select("host", F.explode(suffixes).alias("suffix")).join(dims, "suffix")
    best = met.groupBy("host").agg(F.max_by(F.struct("publisher", "tier", "kind", "independence", "stance"), F.length("suffix")).alias("p"))
    out = named.join(best, "host", "left")
    other = {"publisher": F.col("host"), "tier": F.lit("other"), "kind": F.lit("news"), "independence": F.col("host"), "stance": F.lit("neutral")}
    return out.select(*rows.columns, "host", *[F.coalesce(F.col(f"p.{k}"), v).alias(k) for k, v in other.items()])


# ------------------------------------------------------------------ tags


def exchange_tickers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_words(EXCHANGE_TICKER)), F.lit(1))))


def macro_tags(text: Column) -> Column:
    low = F.lower(text)
    words = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k.strip())) for k in MACRO_KEYWORDS]))
    proxies = F.flatten(F.array_compact(F.array(*[F.when(_hit(text, p), F.array(*[F.lit(s) for s in symbols])) for p, symbols in COMMODITY_PROXIES])))
    return F.struct(words.alias("keywords"), proxies.alias("proxies"))


def alias_hits(rows: DataFrame, key: str, text: Column, aliases: DataFrame, alias: str, symbol: str, longest: int = 4) -> DataFrame:
    """key and symbol for every alias (of up to ``longest`` words) that a text has as whole words.

    The runs of words of a text meet the normalised aliases by an equi-join, so the dictionary may be of any size. The words
    are split once a text: each run is its first word and the words at the places after it.
    """
    from tidewire.functions.text import normalise_headline

    split = rows.select(F.col(key).alias("key"), F.split(normalise_headline(text), " ").alias("words"))
    run = lambda n: F.transform("words", lambda w, i: F.when(i + n <= F.size("words"), F.concat_ws(" ", w, *[F.get("words", i + k) for k in range(1, n)])))
    grams = split.select("key", F.explode(F.array_distinct(F.concat(*[run(n) for n in range(1, longest + 1)]))).alias("gram")).filter("gram <> ''")
    known = aliases.select(normalise_headline(F.col(alias)).alias("gram"), F.col(symbol).alias("symbol")).filter("gram <> ''").distinct()
    return grams.join(known, "gram").select(F.col("key").alias(key), "symbol").distinct()


def alias_index(instruments: DataFrame, symbol: str = "symbol", short: str = "short", aliases: str = "aliases", asset_class: str = "asset_class") -> DataFrame:
    """alias, symbol and cased of active instruments: names to look for in a text.

    Symbols and what looks like one (2 to 6 capitals) are sought with regard to case, names of several words and single words of 6
    characters or more without. Words of the stop list, single characters, denied names and, of commodities, currencies and rates,
    single words other than the symbol are left out.
    """
    names = F.array_compact(F.concat(F.array(F.col(symbol)), F.coalesce(F.col(aliases), F.array().cast("array<string>")), F.array(F.col(short))))
    rows = instruments.select(F.col(symbol).alias("symbol"), F.col(asset_class).alias("kind"), F.explode(names).alias("raw")).withColumn("alias", F.trim("raw"))
    several, own = F.col("alias").contains(" "), F.col("alias") == F.col("symbol")
    capitals = ~several & (F.upper("alias") == F.col("alias")) & F.col("alias").rlike(r"\p{Lu}") & F.length("alias").between(2, 6)
    cased = own | capitals
    kept = rows.filter((F.col("alias") != "") & ~F.lower("alias").isin(GATE_STOPWORDS) & ~(F.coalesce(F.col("kind").isin(PROXY_CLASSES), F.lit(False)) & ~several & ~own) & (several | (F.length("alias") >= 2)))
    kept = kept.filter(F.when(cased, ~F.col("alias").isin(SYMBOLS_DENIED)).otherwise((several | (F.length("alias") >= 6)) & ~F.lower("alias").isin(ALIASES_DENIED)))
    return kept.select(F.when(cased, F.col("alias")).otherwise(F.lower("alias")).alias("alias"), "symbol", cased.alias("cased")).distinct()


def tagged(rows: DataFrame, key: str, title: Column, body: Column, index: DataFrame) -> DataFrame:
    """key, exchange tickers, symbols and macro keywords of each text: its title and the first 400 characters of its body.

    ``index`` comes from ``alias_index`` and may be of any size: a text meets it by the words (or letters beyond ASCII) that the
    aliases begin with, and an alias counts where no ASCII letter or digit stands beside it. Keys must be unique.
    """
    full = F.concat(F.coalesce(title, F.lit("")), F.lit("  ||  "), F.substring(F.coalesce(body, F.lit("")), 1, 400))
    texts = rows.select(F.col(key).alias("key"), full.alias("full"))
    atoms = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+|[^\x00-\x7f])"), F.lit(1))
    begins = index.select("alias", "symbol", "cased", F.try_element_at(atoms(F.col("alias")), F.lit(1)).alias("atom")).filter("atom IS NOT NULL")
    met = texts.select("key", F.explode(F.array_distinct(atoms(F.col("full")))).alias("atom")).join(begins, "atom")
    near = met.groupBy("key").agg(F.collect_set(F.struct("alias", "symbol", "cased")).alias("near"))  # the text comes to its aliases once, not to each of its words
    exact = lambda c, letters: F.concat(F.lit(f"(?<![{letters}])\\Q"), c["alias"], F.lit(f"\\E(?![{letters}])"))
    holds = lambda c: F.when(c["cased"], F.rlike("full", exact(c, "A-Za-z0-9"))).otherwise(F.rlike(F.lower("full"), exact(c, "a-z0-9")))
    named = F.coalesce(F.transform(F.filter("near", holds), lambda c: c["symbol"]), F.array().cast("array<string>"))
    macro = macro_tags(F.col("full"))
    out = texts.join(near, "key", "left").select("key", exchange_tickers(F.col("full")).alias("exchange_tickers"), macro.alias("macro"), named.alias("named"))
    all_symbols = F.array_sort(F.array_distinct(F.concat("named", F.col("macro.proxies"))))
    return out.select(F.col("key").alias(key), "exchange_tickers", all_symbols.alias("symbols"), F.array_sort("macro.keywords").alias("macro_keywords"))


def canonical(instruments: DataFrame, symbol: str, pointer: str, active: str) -> DataFrame:
    """symbol and canonical symbol: the target an alias row points to if that is active, else the symbol itself."""
    target = instruments.filter(F.col(active)).select(F.col(symbol).alias("__target"))
    return instruments.join(target, F.col(pointer) == F.col("__target"), "left").select(symbol, F.coalesce("__target", symbol).alias("canonical"))


# ------------------------------------------------------------------ routing


def routed(c: dict[str, Column], active_tickers: Column, active_sectors: Column, active_regions: Column) -> Column:
    """route and reason of a group: an ordered list of rules, the first that holds decides.

    ``c`` has max_materiality, pubs, tier1, institutional, tickers, sectors, regions, event_class, press_wire, non_pr, min_age_h, macro.
    """
    mat, pubs, tier1, inst, cls, age = c["max_materiality"], c["pubs"], c["tier1"], c["institutional"], c["event_class"], c["min_age_h"]
    strict, relaxed = age.isNull() | (age <= STRICT_HOURS), age.isNull() | (age <= RELAXED_HOURS)
    corroborated = tier1 | inst | (pubs >= 2)
    meets = lambda a, b: F.arrays_overlap(a, b)
    of = lambda names: F.coalesce(cls.isin(*names), F.lit(False))
    mainstream = meets(c["tickers"], F.array(*[F.lit(s) for s in MAINSTREAM_SYMBOLS]))
    single = c["non_pr"] & ~c["press_wire"] & strict
    rules = [
        ("discard", "floor", (mat == 0) & ~meets(c["tickers"], active_tickers) & ~c["macro"] & ~tier1 & ~inst),
        ("sharp_promote", "R0", inst & of(AUTOPROMOTE_CLASSES) & (mat >= 50) & strict),
        ("sharp_promote", "R0b", inst & of(["regulatory"]) & (mat >= 70) & relaxed),
        ("sharp_promote", "R0c", (pubs >= 3) & tier1 & relaxed),
        ("sharp_promote", "R1", (mat >= 30) & tier1 & relaxed),
        ("sharp_promote", "R2", (pubs >= 3) & (mat >= 25) & relaxed),
        ("sharp_promote", "R2b", (pubs >= 2) & tier1 & (mat >= 25) & relaxed),
        ("sharp_promote", "R3", meets(c["tickers"], active_tickers) & (mat >= 25) & relaxed),
        ("sharp_promote", "R4", of(SHARP_CLASSES) & (mat >= 35) & corroborated & strict),
        ("sharp_promote", "R5", meets(c["sectors"], active_sectors) & (mat >= 25) & corroborated & relaxed),
        ("sharp_promote", "R6", meets(c["regions"], active_regions) & (mat >= 25) & corroborated & relaxed),
        ("sharp_promote", "R7", mainstream & of(SINGLE_SOURCE_CLASSES) & (mat >= 45) & single),
        ("sharp_promote", "R8", of(AUTOPROMOTE_CLASSES) & (mat >= 55) & single),
    ]
    out = F.struct(F.lit("firehose_store").alias("route"), F.lit("default").alias("reason"))
    for route, reason, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def reason_rank(reason: Column) -> Column:
    """Place of the first rule in the order of admission that the reason begins with; behind all where there is none."""
    out = F.lit(len(REASON_ORDER))
    for i in range(len(REASON_ORDER) - 1, -1, -1):
        out = F.when(reason.startswith(REASON_ORDER[i]), i).otherwise(out)
    return out


def funnel(decisions: DataFrame, route: str, reason: str, admitted: str | None = None) -> DataFrame:
    """stage and n: all, each route, each reason, and what was admitted or not."""
    rows = F.array(
        F.concat(F.lit("route:"), F.col(route)),
        F.lit("all"),
        F.when(F.col(route) == "sharp_promote", F.concat(F.lit("reason:"), F.col(reason))),
        *([F.when(F.col(admitted), "admitted").otherwise("overflow")] if admitted else []),
    )
    return decisions.select(F.explode(F.array_compact(rows)).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


def funnel_report(decisions: DataFrame, run: list[str], route: str, verdict: str, made: str, members: str) -> DataFrame:
    """A row for each run: how many groups were evaluated, took each route, were admitted or overflowed by budget and by diversity; how many of those admitted became a story
    (``made`` true) or were rejected, the share rejected of those admitted, the share made of those promoted (0 without any), and sizes of those admitted."""
    promoted, admitted = F.col(route) == "sharp_promote", F.col(verdict) == "admitted"
    count = lambda c, n: F.count_if(F.coalesce(c, F.lit(False))).alias(n)
    size = F.col(members)
    out = decisions.groupBy(*run).agg(
        F.count("*").alias("evaluated"), *[count(F.col(route) == r, r) for r in ("discard", "firehose_store", "sharp_promote")], count(promoted & admitted, "admitted"), count(promoted & (F.col(verdict) == "budget"), "overflow_budget"), count(promoted & (F.col(verdict) == "diversity"), "overflow_diversity"),
        count(admitted & F.col(made), "made"), count(admitted & ~F.col(made), "rejected"), count(admitted & (size <= 1), "size_1"), count(admitted & (size == 2), "size_2"), count(admitted & size.between(3, 5), "size_3_5"), count(admitted & (size >= 6), "size_6"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(0.0)
    return out.withColumns({"reject_rate": share("rejected", "admitted"), "promote_yield": share("made", "sharp_promote")})


# ------------------------------------------------------------------ groups of news


def group_summary(members: DataFrame, key: str) -> DataFrame:
    """What a group says of its members: materiality (capped where all come from press wires), sets of tickers, sectors and regions,
    independent publishers (state media apart), flags, times, and the most frequent event class, ties by name."""
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    flag = lambda c, n: F.coalesce(F.bool_or(c), F.lit(False)).alias(n)
    seen = F.coalesce("published_at", "created_at")
    out = members.groupBy(key).agg(
        F.max("materiality_score").alias("__most"), F.bool_and(F.col("kind") == "pr_wire").alias("__wire"), F.count("*").alias("members"),
        F.countDistinct(F.when(F.col("stance") != "state_media", F.col("independence"))).alias("independent_pub_count"),
        sets("tickers"), sets("sectors"), sets("regions"),
        flag(F.col("tier").isin("wire", "tier1"), "has_tier1_primary"), flag(F.col("kind") == "institutional", "has_institutional_primary"), flag(F.col("kind") == "pr_wire", "has_press_wire_primary"), flag(F.col("kind") == "news", "has_non_pr_news_primary"),
        F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"),
    )
    counts = members.filter("event_class IS NOT NULL").groupBy(key, "event_class").agg(F.count("*").alias("n"))
    mode = counts.groupBy(key).agg(F.min_by("event_class", F.struct(-F.col("n"), F.col("event_class"))).alias("event_class"))
    score = F.when(F.col("__wire"), F.least(F.col("__most"), F.lit(PR_WIRE_CAP))).otherwise(F.col("__most"))
    return out.withColumn("max_materiality", score).drop("__most", "__wire").join(mode, key, "left")
