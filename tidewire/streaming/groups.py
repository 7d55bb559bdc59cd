"""Groups of news as state of a stream: what a group says of its members, with counts of event classes and a time to live.

A group is one value of state (extremes, flags, the members of its sets, a count for each event class), which a batch reads once and writes once, and
one event-time timer, which ends it ``horizon_h`` after its last member: its state goes, a last row says so, and the next member of the key opens
a group anew. Members come to the processor as JSON, and groups are kept and come out as JSON: Python reads a row cell by cell, which for lists took
longer than all else. What a member says is reckoned in columns before, what a group says in columns after. Rows that arrived late never join a
group: each is a group of its own, emitted at once and closed at its own time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.fixed_values import PR_WIRE_CAP

HORIZON_HOURS = 72
SETS = ("tickers", "sectors", "regions", "publishers")
FLAGS = ("has_tier1_primary", "has_institutional_primary", "has_press_wire_primary", "has_non_pr_news_primary")
#: Bits of ``flags``: FLAGS in order, then that some member with a kind is no press wire. Times are microseconds.
OTHER_KIND = 1 << len(FLAGS)
GROUP = "most int, flags int, members long, first long, last long, opened_by long, " + ", ".join(f"{k} array<string>" for k in SETS) + ", classes map<string, long>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in a store that has maps and timers."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)


class GroupProcessor(StatefulProcessor):
    """State of one group; see the module."""

    def __init__(self, key: str, horizon_h: float):
        self.horizon_ms = int(horizon_h * 3_600_000)
        self.row = Row(key, "late", "state", "closed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "state string")

    def handleInputRows(self, key, rows, timerValues):
        old = json.loads(self.value.get()[0]) if self.value.exists() else None
        g = old or {"most": None, "flags": 0, "members": 0, "first": None, "last": None, "opened_by": None, "classes": {}}
        sets, counts, before, items = {k: set(g.get(k, ())) for k in SETS}, g["classes"], g["last"], []
        for r in rows:
            m = json.loads(r["member"])
            score, at, event = m.get("score"), m.get("at"), m.get("event_class")
            if score is not None and (g["most"] is None or score > g["most"]):
                g["most"] = score
            if at is not None:
                g["first"], g["last"] = min(at, at if g["first"] is None else g["first"]), max(at, at if g["last"] is None else g["last"])
            g["flags"] |= m["flags"]
            g["members"] += 1
            items.append(m["item"])
            for k in SETS:
                sets[k].update(m.get(k, ()))
            if event is not None:
                counts[event] = counts.get(event, 0) + 1
        if old is None:
            g["opened_by"] = min(items)
        state = json.dumps({**g, **{k: [x for x in told if x is not None] for k, told in sets.items()}})
        if not key[1]:  # nothing joins a late one, which keeps no state
            self.value.update((state,))
            if g["last"] != before:
                if before is not None:
                    self.handle.deleteTimer(self._end(before))
                self.handle.registerTimer(self._end(g["last"]))
        yield self.row(*key, state, bool(key[1]))

    def _end(self, last: int) -> int:
        return last // 1000 + self.horizon_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.row(*key, self.value.get()[0], True)
        self.value.clear()

    def close(self) -> None:
        pass


def group_states(news: DataFrame, key: str, item: str, late: Column, watermark: str, horizon_h: float = HORIZON_HOURS) -> DataFrame:
    """For the output mode ``update``: the groups that a batch of the stream changed, opened or ended, with the columns of ``rules.group_summary``. A group is known by
    its key, ``late`` (the item, where a late row is a group of its own) and ``opened_by``, the least item of the batch that opened it."""
    rows = news.withColumns({"seen": F.coalesce("published_at", "created_at"), "item": F.col(item).cast("long"), "late": F.when(late, F.col(item).cast("long").cast("string")).otherwise("")}).withWatermark("seen", watermark)  # a null key would not group
    kind = F.col("kind")
    bits = (F.col("tier").isin("wire", "tier1"), kind == "institutional", kind == "pr_wire", kind == "news", kind != "pr_wire")
    flags = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(bits)), F.lit(0))
    publisher = F.when(F.coalesce(F.col("stance") != "state_media", F.lit(True)), F.col("independence"))
    member = F.to_json(F.struct("item", F.unix_micros("seen").alias("at"), F.col("materiality_score").alias("score"), flags.alias("flags"), F.array_compact(F.array(publisher)).alias("publishers"), *SETS[:3], "event_class"))
    states = rows.select(key, "late", "seen", member.alias("member")).groupBy(key, "late").transformWithState(GroupProcessor(key, horizon_h), f"`{key}` {dict(news.dtypes)[key]}, late string, state string, closed boolean", "update", "eventTime")
    g = {c: F.col(f"__g.{c}") for c in ("most", "flags", "members", "first", "last", "opened_by", *SETS, "classes")}
    wire = g["flags"].bitwiseAND(OTHER_KIND) == 0
    counted = F.transform(F.map_entries(g["classes"]), lambda c: F.struct((-c["value"]).alias("n"), c["key"].alias("event_class")))
    return states.withColumn("__g", F.from_json("state", GROUP)).select(
        key, F.nullif("late", F.lit("")).cast("long").alias("late"), g["opened_by"], F.when(wire, F.least(g["most"], F.lit(PR_WIRE_CAP))).otherwise(g["most"]).alias("max_materiality"), g["members"], F.size(g["publishers"]).alias("independent_pub_count"),
        *[F.array_sort(g[k]).alias(k) for k in SETS[:3]], *[(g["flags"].bitwiseAND(1 << k) > 0).alias(f) for k, f in enumerate(FLAGS)],
        F.timestamp_micros(g["first"]).alias("first_seen_at"), F.timestamp_micros(g["last"]).alias("last_seen_at"), F.array_min(counted)["event_class"].alias("event_class"), "closed",
    )
