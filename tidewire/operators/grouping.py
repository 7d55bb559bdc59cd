"""Online grouping of news at any length: stretches of time in parallel, repaired until nothing changes.

Which group an item joins depends on every decision before it. The table is dealt by ranges of (time, item) into stretches of about
``STRETCH_ROWS`` rows. First all stretches are grouped in parallel as if nothing came before them. Then, again and again, the groups that
are live when a stretch begins are derived from the decisions so far (sets that grow, counts of event classes, headlines and times), and all
stretches behind the first change are grouped anew in parallel, each from the groups it begins with. An item that joined a group whose first item
has joined another follows it. A round without a change is the answer that grouping in order gives: by induction, a stretch whose
predecessors are settled begins with the right groups. Each round settles at least one more stretch, in practice many.

Within a stretch candidates come from indexes (ticker, headline, event class), not from all live groups: without a ticker in
common a score reaches the threshold only with the same event class and regions.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.fixed_values import CENTROID_SCAN, CHEAP_ATTACH, EMBEDDING_ATTACH
from tidewire.session import cut

#: Hours after which an item is too old to join, a headline is forgotten, a group that was not seen is not joined any more.
STALE_HOURS, HEADLINE_HOURS, STATE_HOURS = 48, 48, 72
STRETCH_ROWS = 50_000
SETS = ("tickers", "sectors", "regions")
STATE = "s int, grp long, born double, seen double, tickers array<string>, sectors array<string>, regions array<string>, classes array<struct<event_class:string,n:bigint>>, tokens array<string>, hashes array<struct<hash:string,t:double>>, vector array<double>"


def _j(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def attach_score(a: dict, b: dict) -> float:
    """0.4 tickers, 0.2 sectors, 0.1 regions, 0.2 event class, 0.1 words of the headline."""
    event = 1.0 if a["event_class"] and a["event_class"] == b["event_class"] else 0.0
    return 0.4 * _j(a["tickers"], b["tickers"]) + 0.2 * _j(a["sectors"], b["sectors"]) + 0.1 * _j(a["regions"], b["regions"]) + 0.2 * event + 0.1 * _j(a["tokens"], b["tokens"])


def most_score(item: dict) -> float:
    """What ``attach_score`` can't exceed for an item: everything that it has in common, summed in the same order."""
    a, b, c, d, e = (1.0 if item[k] else 0.0 for k in (*SETS, "event_class", "tokens"))
    return 0.4 * a + 0.2 * b + 0.1 * c + 0.2 * d + 0.1 * e


def vector_score(item: dict, group: dict) -> float:
    """0.6 cosine to the vector of the group's first item, 0.4 tickers."""
    a, b = item["vector"], group["vector"]
    norm = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0.0
    return 0.6 * (float(a @ b) / norm if norm else 0.0) + 0.4 * _j(item["tickers"], group["tickers"])


class OnlineGroups:
    """The groups that can still be joined, each known by its first item; times are hours and ascend from call to call. Groups and headlines stand in the order in which
    they were seen last, so those that are too old to matter leave from the front, each once, and an item meets none of them."""

    def __init__(self):
        self.live: OrderedDict[int, dict] = OrderedDict()  # seen last comes last, here and in the next two
        self.by_ticker: dict[str, dict] = {}
        self.by_class: dict[str, dict] = {}
        self.by_hash: dict[str, dict] = {}
        self.with_vector: OrderedDict[int, None] = OrderedDict()
        self.headlines: OrderedDict[tuple[str, int], float] = OrderedDict()

    def restore(self, states: list[dict]) -> None:
        """Begin with groups of earlier stretches."""
        for s in sorted(states, key=lambda s: (s["seen"], s["born"], s["grp"])):
            vector = None if s["vector"] is None else np.asarray(s["vector"], float)
            g = {"born": (s["born"], s["grp"]), "seen": s["seen"], "tokens": set(s["tokens"]), "vector": vector, "classes": {c["event_class"]: c["n"] for c in s["classes"]}, "event_class": None, **{k: set() for k in SETS}}
            self._enter(int(s["grp"]), g, {k: set(s[k]) for k in SETS})
        for t, grp, h in sorted(((h["t"], int(s["grp"]), h["hash"]) for s in states for h in s["hashes"]), key=lambda x: x[:2]):
            self._tell(h, grp, t)

    def _tell(self, headline: str, key: int, t: float) -> None:
        self.by_hash.setdefault(headline, {})[key] = t
        self.headlines[headline, key] = t
        self.headlines.move_to_end((headline, key))

    def _enter(self, key: int, g: dict, sets: dict) -> None:
        self.live[key] = g
        self._grow(key, sets)
        for c in g["classes"]:
            self.by_class.setdefault(c, {})[key] = None
        self._name(g)
        if g["vector"] is not None:
            self.with_vector[key] = None

    def _grow(self, key: int, sets: dict) -> None:
        g = self.live[key]
        for t in sets["tickers"] - g["tickers"]:
            self.by_ticker.setdefault(t, {})[key] = None
        for k in SETS:
            g[k] |= sets[k]

    @staticmethod
    def _name(g: dict) -> None:
        g["event_class"] = min(g["classes"], key=lambda c: (-g["classes"][c], c), default=None)

    @staticmethod
    def _leave(index: dict, name: str | None, key: int) -> None:
        del index[name][key]
        if not index[name]:
            del index[name]

    def _expire(self, now: float) -> None:
        while self.headlines and now - next(iter(self.headlines.values())) > HEADLINE_HOURS:
            (headline, key), _ = self.headlines.popitem(last=False)
            self._leave(self.by_hash, headline, key)
        while self.live and now - next(iter(self.live.values()))["seen"] > STATE_HOURS:
            key, g = self.live.popitem(last=False)
            for index, names in ((self.by_ticker, g["tickers"]), (self.by_class, g["classes"])):
                for n in names:
                    self._leave(index, n, key)
            self.with_vector.pop(key, None)

    def _by_headline(self, item: dict, now: float) -> int | None:
        known = [k for k, t in self.by_hash.get(item["hash"], {}).items() if now - t <= HEADLINE_HOURS and k in self.live]
        return min(known, key=lambda k: self.live[k]["born"], default=None)

    def _by_features(self, item: dict, now: float) -> int | None:
        if most_score(item) < CHEAP_ATTACH - 1e-12:
            return None
        near = set().union(*(self.by_ticker.get(t, ()) for t in item["tickers"]))
        if item["regions"] and item["event_class"]:
            near.update(self.by_class.get(item["event_class"], ()))
        best, top = None, 0.0
        for k in sorted(near, key=lambda k: self.live[k]["born"]):
            g = self.live[k]
            if now - g["seen"] <= STATE_HOURS and (s := attach_score(item, g)) >= CHEAP_ATTACH - 1e-12 and s > top:
                best, top = k, s
        return best

    def _by_vector(self, item: dict, now: float) -> int | None:
        known, edge = [], None
        for k in reversed(self.with_vector):
            seen = self.live[k]["seen"]
            if now - seen > STATE_HOURS or (edge is not None and seen < edge):
                break
            known.append(k)
            if len(known) == CENTROID_SCAN:
                edge = seen
        known = sorted(known, key=lambda k: (-self.live[k]["seen"], self.live[k]["born"]))[:CENTROID_SCAN]
        scores = {k: vector_score(item, self.live[k]) for k in known if self.live[k]["tickers"] & item["tickers"]}  # the threshold needs a ticker in common
        top = max(scores.values(), default=0.0)
        if top < EMBEDDING_ATTACH - 1e-12:
            return None
        return min((k for k, s in scores.items() if s == top), key=lambda k: self.live[k]["born"])

    def attach(self, key: int, item: dict, now: float) -> int:
        """The first item of the group that an item joins, or its own key. One published over ``STALE_HOURS`` ago joins none and isn't joined; else the same headline
        within ``HEADLINE_HOURS``, else the best score among groups seen within ``STATE_HOURS``; then, for an item with a vector, the best ``vector_score`` among the
        ``CENTROID_SCAN`` groups with a vector seen last. Of equals the group that began first."""
        if item["published_h"] is not None and now - item["published_h"] > STALE_HOURS:
            return key
        self._expire(now)
        best = self._by_headline(item, now)
        if best is None:
            best = self._by_features(item, now)
        if best is None and item.get("vector") is not None:
            best = self._by_vector(item, now)
        if best is None:
            best = key
            self._enter(key, {"born": (now, key), "seen": now, "tokens": item["tokens"], "vector": item.get("vector"), "classes": {}, "event_class": None, **{k: set() for k in SETS}}, {k: item[k] for k in SETS})
        else:
            self._grow(best, item)
        g = self.live[best]
        if item["event_class"]:
            g["classes"][item["event_class"]] = g["classes"].get(item["event_class"], 0) + 1
            self.by_class.setdefault(item["event_class"], {})[best] = None
            self._name(g)
        self._tell(item["hash"], best, now)
        g["seen"] = now
        self.live.move_to_end(best)
        if best in self.with_vector:
            self.with_vector.move_to_end(best)
        return best


def group_online(items: list[dict], now_h: list[float]) -> list[int]:
    """The number of the group of each item, in order."""
    groups, numbers = OnlineGroups(), {}
    first = [groups.attach(k, item, now) for k, (item, now) in enumerate(zip(items, now_h, strict=True))]
    return [numbers.setdefault(k, len(numbers)) for k in first]


# ------------------------------------------------------------------ stretches


def hours(c: Column | str) -> Column:
    return F.unix_micros(c) / 3.6e9


def _run(rows: pd.DataFrame, states: list[dict]) -> pd.DataFrame:
    groups, out = OnlineGroups(), []
    groups.restore(states)
    rows = rows.sort_values(["now", "item"], ignore_index=True)
    for r in rows.to_dict("records"):
        if pd.isna(r["now"]):
            out.append(r["item"])
            continue
        item = {k: set() if r[k] is None else set(r[k]) for k in (*SETS, "tokens")}
        item |= {"event_class": r["event_class"], "hash": r["hash"], "published_h": None if pd.isna(r["published"]) else r["published"], "vector": None if r["vector"] is None else np.asarray(r["vector"], float)}
        out.append(groups.attach(r["item"], item, r["now"]))
    return pd.DataFrame({"item": rows["item"], "k": rows["k"], "grp": np.array(out, np.int64)})


DECIDED = "item long, k int, grp long"


def _alone(rows: pd.DataFrame) -> pd.DataFrame:
    """A stretch behind guests, the items of the stretch before it, whose decisions don't count."""
    return _run(rows, [])[~rows.sort_values(["now", "item"])["guest"].to_numpy()]


def _behind(rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    return _run(rows, states.to_dict("records")) if len(rows) else pd.DataFrame({"item": [], "k": [], "grp": []}).astype({"item": "int64", "k": "int32", "grp": "int64"})


def _carried(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of groups in the order of stretches, with sets and counts of all stretches so far; a group streams through."""
    own, sets, counts = None, {}, {}
    for rows in parts:
        out = []
        for r in rows.to_dict("records"):
            if r["grp"] != own:
                own, sets, counts = r["grp"], {k: set() for k in SETS}, {}
            for k in SETS:
                sets[k] |= set(r[k])
            for c in r["classes"]:
                counts[c["event_class"]] = counts.get(c["event_class"], 0) + c["n"]
            out.append({**r, **{k: list(sets[k]) for k in SETS}, "classes": [{"event_class": c, "n": n} for c, n in sorted(counts.items())]})
        yield pd.DataFrame(out, columns=rows.columns)


def _states(items: DataFrame, decided: DataFrame, starts: np.ndarray, behind: int) -> DataFrame:
    """The groups that are live when each stretch after ``behind`` begins, as the decisions so far have it."""

    def last_begun(after: float):
        @F.pandas_udf("int")
        def found(t: pd.Series) -> pd.Series:
            return pd.Series((np.searchsorted(starts, t.to_numpy() + after, "right") - 1).astype(np.int32))

        return found

    fresh = F.col("now").isNotNull() & (F.col("published").isNull() | (F.col("now") - F.col("published") <= STALE_HOURS))
    members = items.filter(fresh).join(decided.select("item", "grp"), "item")
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))).alias(c)
    parts = members.groupBy("grp", "k").agg(F.max("now").alias("seen"), *[all_of(c) for c in SETS])
    named = members.filter("event_class <> ''").groupBy("grp", "k", "event_class").agg(F.count("*").alias("n")).groupBy("grp", "k").agg(F.collect_list(F.struct("event_class", "n")).alias("classes"))
    parts = parts.join(named, ["grp", "k"], "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<struct<event_class:string,n:bigint>>")))
    parts = parts.withColumn("until", F.coalesce(F.lead("k").over(Window.partitionBy("grp").orderBy("k")), F.lit(len(starts) - 1)))
    carried = parts.repartition("grp").sortWithinPartitions("grp", "k").mapInPandas(_carried, parts.schema)
    reach = F.least("until", last_begun(STATE_HOURS)("seen"))
    live = carried.withColumn("s", F.explode(F.when(reach > F.col("k"), F.sequence(F.col("k") + 1, reach)))).filter(F.col("s") > behind)
    each = members.groupBy("grp", "k", "hash").agg(F.max("now").alias("t"))
    reach = last_begun(HEADLINE_HOURS)("t")
    told = each.withColumn("s", F.explode(F.when(reach > F.col("k"), F.sequence(F.col("k") + 1, reach)))).filter(F.col("s") > behind).groupBy("s", "grp", "hash").agg(F.max("t").alias("t")).groupBy("s", "grp").agg(F.collect_list(F.struct("hash", "t")).alias("hashes"))
    first = items.select(F.col("item").alias("grp"), F.col("now").alias("born"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "vector")
    out = live.drop("k", "until").join(told, ["s", "grp"], "left").join(first, "grp")
    return out.select("s", "grp", "born", "seen", *SETS, "classes", "tokens", F.coalesce("hashes", F.array().cast("array<struct<hash:string,t:double>>")).alias("hashes"), "vector")


def _followed(decided: DataFrame) -> DataFrame:
    """Items that joined a group whose first item has joined another go there."""
    first = decided.select(F.col("item").alias("grp"), F.col("grp").alias("onward")).filter("grp <> onward")
    return decided.join(first, "grp", "left").select("item", "k", F.coalesce("onward", "grp").alias("grp"))


def online_groups(news: DataFrame, item: str, at: str, seen: str, stretch_rows: int = STRETCH_ROWS) -> tuple[DataFrame, int]:
    """(item, grp, block) of news with tickers, sectors, regions, tokens, event_class, hash and perhaps a vector, and how many rounds it took. ``grp`` is the first item
    of the group, ``block`` the 72 hours in which that was seen. Items are unique longs; one without a time is a group of its own."""
    vector = F.col("vector").cast("array<double>") if "vector" in news.columns else F.lit(None).cast("array<double>")
    rows = cut(news.select(F.col(item).cast("long").alias("item"), hours(at).alias("published"), hours(seen).alias("now"), *SETS, "tokens", "event_class", "hash", vector.alias("vector")))
    n = max(1, -(-rows.count() // stretch_rows))
    items = rows.withColumn("k", F.lit(0))
    if n > 1:
        items = cut(rows.repartitionByRange(n, "now", "item").withColumn("k", F.spark_partition_id()))
    guests = items.filter(F.col("k") < n - 1).withColumns({"k": F.col("k") + 1, "guest": F.lit(True)})
    decided, rounds = cut(items.withColumn("guest", F.lit(False)).unionByName(guests).groupBy("k").applyInPandas(_alone, DECIDED)), 1
    if n > 1:
        found = {r["k"]: r["t"] for r in items.groupBy("k").agg(F.min("now").alias("t")).collect()}  # a number a stretch
        starts = np.array([found.get(k) if found.get(k) is not None else np.nan for k in range(n)], float)
        starts = pd.Series(starts).bfill().fillna(np.inf).to_numpy()  # empty stretches begin with the next one
        settled: int | None = 0
        while settled is not None:
            again = items.filter(F.col("k") > settled).groupBy("k").cogroup(_states(items, decided, starts, settled).groupBy("s")).applyInPandas(_behind, DECIDED)
            before = decided
            found_now = cut(decided.filter(F.col("k") <= settled).unionByName(again))  # following reads it several times, and each would group anew
            decided = cut(_followed(_followed(found_now)))
            changed = decided.join(before.select("item", F.col("grp").alias("was")), "item").filter("grp <> was")
            settled, rounds = changed.agg(F.min("k")).first()[0], rounds + 1
    begun = rows.select(F.col("item").alias("grp"), F.floor(F.col("now") / STATE_HOURS).alias("block"))
    return decided.join(begun, "grp").select(F.col("item").alias(item), "grp", "block"), rounds
