"""Operators whose every step depends on the ones before: composition, admission, pruning, daily caps.

Each runs over one key at a time, in pandas. The keys' sizes are bounded by what the operator is for: a feed is a page, an admission a
run's candidates, a pruned group an event's members. Online grouping, which has no such bound, is in ``grouping``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.fixed_values import COHERENCE, DIVERSITY_SHARE, DIVERSITY_START, FEED_WINDOWS, SYNTHESIS_BUDGET
from tidewire.operators.grouping import group_online  # noqa: F401
from tidewire.operators.relational import latest_per_key


def compose(items: list[tuple], windows: dict = FEED_WINDOWS) -> list[int]:
    """Order of the feed: of (lead ticker or None, is social) in the order of score, again and again the first that breaks no
    rule, or the head where all do. Nothing is dropped."""
    left, out = list(range(len(items))), []
    while left:
        tail = [items[i] for i in out]
        for i in left:
            lead, social = items[i]
            if lead is not None:
                if tail and tail[-1][0] == lead:
                    continue
                if sum(x[0] == lead for x in tail[-(windows["ticker_slots"] - 1) :]) >= windows["ticker_cap"]:
                    continue
            if social and sum(x[1] for x in tail[-(windows["social_slots"] - 1) :]) >= windows["social_cap"]:
                continue
            break
        else:
            i = left[0]
        left.remove(i)
        out.append(i)
    return out


def feed_compose(candidates: DataFrame, user: str, item: str, score: str, created: str, lead: str, social: str, most: int = 500) -> DataFrame:
    """The feed of every user: its ``most`` best candidates (a page is no longer), composed; position and demotions of each."""
    best = latest_per_key(candidates, [user], [F.desc(score), F.desc(created), F.col(item)], most)
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, created, item], ascending=[False, False, True], ignore_index=True)
        order = compose([(None if pd.isna(a) else a, bool(b)) for a, b in zip(rows[lead], rows[social], strict=True)])
        return pd.DataFrame({user: rows[user].to_numpy()[order], item: rows[item].to_numpy()[order], "position": np.arange(len(order)), "demotions": np.maximum(0, np.arange(len(order)) - np.array(order))})

    return best.select(user, item, score, created, lead, social).groupBy(user).applyInPandas(run, f"`{user}` {kinds[user]}, `{item}` {kinds[item]}, position int, demotions int")


def admit(keys: list, exempt: list[bool], budget: int = SYNTHESIS_BUDGET) -> list[str]:
    """``admitted``, ``budget`` or ``diversity`` for each candidate in order: once twenty are in, no key may take its share."""
    out, counts, n = [], {}, 0
    for key, free in zip(keys, exempt, strict=True):
        if n >= budget:
            out.append("budget")
        elif n >= DIVERSITY_START and not free and counts.get(key, 0) + 1 > max(1, int((n + 1) * DIVERSITY_SHARE)):
            out.append("diversity")
        else:
            counts[key], n = counts.get(key, 0) + 1, n + 1
            out.append("admitted")
    return out


def diversity_admit(candidates: DataFrame, run: str, item: str, order: list, sector: str, region: str, exempt: str, most: int = 1200, budget: int = SYNTHESIS_BUDGET) -> DataFrame:
    """run, item, position and verdict of the ``most`` first candidates of every run, which are found in parts of a run before they meet."""
    salted = candidates.withColumn("__part", F.pmod(F.xxhash64(item), F.lit(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    first = latest_per_key(salted, [run, "__part"], order, most)  # what isn't first in a part of its run isn't in the run
    best = first.withColumn("__at", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("__at") <= most)
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at", ignore_index=True)
        verdict = admit(list(zip(rows[sector], rows[region], strict=True)), [bool(x) for x in rows[exempt]], budget)
        return pd.DataFrame({run: rows[run], item: rows[item], "position": rows["__at"] - 1, "verdict": verdict})

    return best.select(run, item, "__at", sector, region, exempt).groupBy(run).applyInPandas(go, f"`{run}` {kinds[run]}, `{item}` {kinds[item]}, position int, verdict string")


def prune(vectors: list, least: float = COHERENCE) -> list[int]:
    """Places in the order of dropping: while two or more members have vectors, the one whose nearest peer is
    farthest goes, if that is below ``least``."""
    have = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    x = {i: np.asarray(vectors[i], float) / (np.linalg.norm(vectors[i]) or 1.0) for i in have}
    gone = []
    while len(have) > 1:
        peer = {i: max(float(x[i] @ x[j]) if len(x[i]) == len(x[j]) else 0.0 for j in have if j != i) for i in have}
        worst = min(have, key=lambda i: (peer[i], i))
        if peer[worst] >= least:
            break
        have.remove(worst)
        gone.append(worst)
    return gone


def coherence_prune(members: DataFrame, group: str, position: str, member: str, vector: str, least: float = COHERENCE) -> DataFrame:
    """group, member, kept and the order of dropping; a member without a vector stays."""
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__at", member], ignore_index=True)
        order = {p: k for k, p in enumerate(prune(list(rows["__v"]), least))}
        return pd.DataFrame({group: rows[group], member: rows[member], "kept": [i not in order for i in range(len(rows))], "drop_order": pd.array([order.get(i) for i in range(len(rows))], "Int32")})

    rows = members.select(group, F.col(position).alias("__at"), member, F.col(vector).cast("array<double>").alias("__v"))
    return rows.groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{member}` {kinds[member]}, kept boolean, drop_order int")


def daily_cap(topics: DataFrame, day: str, item: str, order: list, ticker: str, cap: int) -> DataFrame:
    """Of every day's topics in order those admitted: the first of each ticker, up to ``cap``. That is a rank among firsts, so plain windows do."""
    first = topics.withColumn("__r", F.row_number().over(Window.partitionBy(day, ticker).orderBy(*order))).filter(F.col("__r") == 1)
    return first.withColumn("position", F.row_number().over(Window.partitionBy(day).orderBy(*order))).filter(F.col("position") <= cap).drop("__r")
