"""Usage ledgers: phase rows with an aggregate, spend against a cap, token cost, histograms, context of matching rows, tool steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_aggregate_rows(phases: DataFrame, request: str, phase: str, cost: str, totals: list[str], status: str, model: str, response: str, order: str) -> DataFrame:
    """The phase rows and one row ``aggregate`` a request: totals and costs summed, the status of a failing phase if there is one, and the
    model of the last ``response`` phase, else of the first phase by ``order``."""
    lead = F.when(F.col(phase) == response, F.struct(F.lit(1).alias("r"), F.col(order).alias("o"))).otherwise(F.struct(F.lit(0).alias("r"), (-F.col(order)).alias("o")))
    sums = [F.sum(c).alias(c) for c in (cost, *totals)]
    bad = F.max(F.when(F.col(status) != "ok", F.col(status)))
    agg = phases.groupBy(request).agg(*sums, F.coalesce(bad, F.lit("ok")).alias(status), F.max_by(model, lead).alias(model))
    cols = [request, phase, cost, *totals, status, model]
    return phases.select(*cols).unionByName(agg.withColumn(phase, F.lit("aggregate")).select(*cols))


def spend_against_cap(ledger: DataFrame, user: str, at: str, amount: str, cap: float, as_of: str | None = None) -> DataFrame:
    """Per user what was spent since midnight of the day of ``as_of`` (the ledger's last time), and what is left of the cap."""
    day = ledger.agg(F.max(at).alias("__now")) if as_of is None else ledger.sparkSession.range(1).select(F.lit(as_of).cast("timestamp").alias("__now"))
    today = F.date_trunc("day", "__now")
    rows = ledger.join(F.broadcast(day))  # one row
    spent = F.round(F.coalesce(F.sum(F.when((F.col(at) >= today) & (F.col(at) < today + F.expr("INTERVAL 1 DAY")), F.col(amount))), F.lit(0.0)), 4)
    return rows.groupBy(user).agg(spent.alias("spent")).select(user, "spent", F.lit(cap).alias("cap"), (F.col("spent") >= cap).alias("over_cap"), F.greatest(F.round(F.lit(cap) - F.col("spent"), 4), F.lit(0.0)).alias("remaining"))


def cost_of(model: Column, rates: list[tuple[str, dict[str, float]]]) -> Column:
    """Dollars of a call whose token counts are in columns named as the rates (per million): the first key in the table that the model's
    name contains decides; an unknown model costs nothing."""
    out = F.lit(0.0)
    for key, per in reversed(rates):
        own = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) * F.lit(r) for c, r in per.items()])
        out = F.when(model.contains(key), F.round(own / 1e6, 6)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def size_histogram(sizes: DataFrame, size: str) -> DataFrame:
    """Counts of the bins 1, 2, 3-5 and 6+, those without any included."""
    c = F.col(size)
    bin_of = F.when(c == 1, "1").when(c == 2, "2").when(c.between(3, 5), "3-5").when(c >= 6, "6+")
    found = sizes.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    bins = sizes.sparkSession.createDataFrame([("1",), ("2",), ("3-5",), ("6+",)], "bin string")
    return bins.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_context(rows: DataFrame, keys: list[str], order: str, text: str, words: list[str], around: int, shown: Column) -> DataFrame:
    """Rows that contain all words, each with what ``shown`` says of it and of up to ``around`` rows before and after it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-around, around)
    hit = reduce(lambda a, b: a & b, [F.col(text).contains(x) for x in words])
    near = rows.withColumn("context", F.array_join(F.collect_list(shown).over(w), " ")).filter(hit)
    return near.select(*keys, order, "context")


def tool_steps(messages: DataFrame, session: str, message: str, role: str, parts: str, created: str) -> DataFrame:
    """Per session: distinct tool calls of its messages summed, and those of the last assistant message.

    ``parts`` is an array of records with ``type`` and ``toolCallId``.
    """
    calls = F.filter(F.coalesce(F.col(parts), F.array().cast("array<struct<type:string,toolCallId:string>>")), lambda p: p["type"].startswith("tool") & p["toolCallId"].isNotNull())
    n = F.size(F.array_distinct(F.transform(calls, lambda p: p["toolCallId"])))
    mine = F.col(role) == "assistant"
    rows = messages.withColumn("__n", n)
    return rows.groupBy(session).agg(F.sum(F.when(mine, F.col("__n")).otherwise(0)).alias("tool_steps"), F.max_by(F.when(mine, F.col("__n")), F.when(mine, F.struct(created, message))).alias("last_tool_steps"))


def due(calls: DataFrame, at: str, as_of: Column, interval_hours: float) -> DataFrame:
    """One row: whether a run is due, as there was none yet or the last is at least half an interval ago."""
    last = calls.agg(F.max(at).alias("last"))
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("last"))) / 3.6e9
    return last.select("last", (F.col("last").isNull() | (age >= interval_hours / 2)).alias("due"))
