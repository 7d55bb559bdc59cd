"""Health of a pipeline: failure streaks, rules with severities, invariants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["ok", "warn", "critical"]


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    when: Column
    says: str


def failure_streak(runs: DataFrame, keys: list[str], order: str, ok: str, name: str) -> DataFrame:
    """How many of the latest runs in a row failed; a run whose outcome is null ends the row."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    good = F.when(F.coalesce(F.col(ok), F.lit(True)), 1).otherwise(0)
    marked = runs.withColumn("__good", F.sum(good).over(w))
    return marked.groupBy(*keys).agg(F.count_if(F.col("__good") == 0).alias(name))


def findings(metrics: DataFrame, rules: list[Rule]) -> DataFrame:
    """The metrics with an array of the findings that hold (rule, severity, message), worst first, and the worst severity as status."""
    level = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)])
    each = F.array(*[F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(-SEVERITIES.index(r.severity)).alias("level"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.says).alias("message"))) for r in rules])
    found = F.array_sort(F.array_compact(each))
    worst = F.array_max(F.transform(found, lambda x: level[x["severity"]]))
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return metrics.withColumn("findings", found).withColumn("status", F.element_at(names, F.coalesce(worst, F.lit(0)) + 1))


def overall(judged: DataFrame) -> DataFrame:
    """One row: the worst status of all, and how many findings of each severity there are."""
    each = judged.select(F.explode("findings").alias("f"))
    counts = each.agg(F.count_if(F.col("f.severity") == "critical").alias("critical"), F.count_if(F.col("f.severity") == "warn").alias("warn"))
    return counts.withColumn("status", F.when(F.col("critical") > 0, "critical").when(F.col("warn") > 0, "warn").otherwise("ok"))


RULE = "code string, severity string, metric string, comparison string, threshold double, threshold_to double, other string, guard string, guard_comparison string, guard_threshold double"


def _holds(comparison: Column, value: Column, low: Column, high: Column, other: Column) -> Column:
    """Whether a metric (a number, or null) meets a rule; what is missing meets only ``missing``."""
    there = value.isNotNull()
    out = F.when(comparison == "missing", ~there).when(comparison == "present", there)
    for name, test in ((">", value > low), (">=", value >= low), ("<", value < low), ("<=", value <= low), ("==", value == low), ("outside", (value < low) | (value > high)), ("below", value < other), ("differs", ~value.eqNullSafe(other))):
        out = out.when(comparison == name, test)
    return F.coalesce(out, F.lit(False))


def judged_by(metrics: DataFrame, entity: list[str], metric: str, value: str, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (entity, code, severity, metric, comparison, threshold, value) and the status of every entity, by a table of rules.

    ``metrics`` has a row for each metric of each entity, with null where it is not known. Rules meet metrics by equal names, and their guards and the
    metrics that they compare with by entity and name, so rules may change without code. Of rules with the same code one finding is left.
    """
    own = metrics.select(*entity, F.col(metric).alias("name"), F.col(value).cast("double").alias("value"))
    met = own.join(rules, own["name"] == rules["metric"]).drop("name")
    also = lambda rows, by, to: rows.join(own.select(*entity, F.col("name").alias(by), F.col("value").alias(to)), [*entity, by], "left")
    full = also(also(met, "guard", "guard_value"), "other", "other_value")
    guarded = F.col("guard").isNull() | _holds(F.col("guard_comparison"), F.col("guard_value"), F.col("guard_threshold"), F.col("guard_threshold"), F.lit(None).cast("double"))
    held = full.filter(guarded & _holds(F.col("comparison"), F.col("value"), F.col("threshold"), F.col("threshold_to"), F.col("other_value")))
    first = held.groupBy(*entity, "code").agg(F.min(F.struct("metric", "comparison", "threshold", "severity", "value")).alias("f"))
    found = first.select(*entity, "code", "f.severity", "f.metric", "f.comparison", "f.threshold", "f.value")
    counts = found.groupBy(*entity).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warn").alias("warn"))
    every = own.select(*entity).distinct().join(counts, entity, "left").fillna(0, ["critical", "warn"])
    return found, every.withColumn("status", F.when(F.col("critical") > 0, "critical").when(F.col("warn") > 0, "warn").otherwise("ok"))


def audit(rows: DataFrame, invariants: list[tuple[str, Column]]) -> DataFrame:
    """name and violations of every invariant, a row that breaks several counting for the first of them; an invariant that can't be
    judged (null) counts as kept."""
    first = F.lit(None).cast("string")
    for name, holds in reversed(invariants):
        first = F.when(~F.coalesce(holds, F.lit(True)), F.lit(name)).otherwise(first)
    counts = rows.withColumn("__first", first).agg(*[F.count_if(F.col("__first") == n).alias(n) for n, _ in invariants])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("violations")) for n, _ in invariants])))


def latest_by_name(log: DataFrame, name: str, at: str, value: str) -> DataFrame:
    return log.groupBy(name).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def labelled_rate(rows: DataFrame, labels: DataFrame, key: str, label: str, good: str, labeler: Column | None = None) -> DataFrame:
    """Counts by label of rows, those without one as ``unlabeled``, and one share of ``good`` ones among the labelled, to 3 digits."""
    own = labels.filter(labeler) if labeler is not None else labels
    joined = rows.join(own.select(key, F.col(label).alias("__label")), key, "left")
    counts = joined.groupBy(F.coalesce("__label", F.lit("unlabeled")).alias("label")).agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col("label") != "unlabeled", F.col("n"))).over(Window.partitionBy())
    hits = F.sum(F.when(F.col("label") == good, F.col("n"))).over(Window.partitionBy())
    return counts.withColumn("good_rate", F.when(known > 0, F.round(F.coalesce(hits, F.lit(0)) / known, 3)))
