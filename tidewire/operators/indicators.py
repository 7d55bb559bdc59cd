"""Series by key: moving averages, strength, bars, returns and changes.

Averages and strength are computed over ranges of (key, time), so that one series is split over many tasks. A range holds the end of one series,
whole ones, and the beginning of another; only the first depends on ranges before. What passes between ranges is small: how many bars came
before, the last values (as many as the longest average looks back, guests of the range), and for each recursive average (exponential, Wilder's) a linear
map: a range takes the average y that it is entered with to a * y + b, and such maps are composed in the order of ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.fixed_values import TIMEFRAMES
from tidewire.session import cut

RANGE_ROWS, BLOCK = 1_000_000, 256


def sma(value: Column, keys: list[str], order: str, n: int) -> Column:
    """Mean of the last n values; null before there are n."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def ema_of(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential average whose first value, at place n - 1, is the mean of the first n."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        k, last = 2 / (n + 1), float(x[:n].mean())
        out[n - 1] = last
        for i in range(n, len(x)):
            last = x[i] * k + last * (1 - k)
            out[i] = last
    return out


def rsi_of(x: np.ndarray, n: int = 14) -> np.ndarray:
    """Wilder's relative strength; 100 where there was no loss, null before n + 1 values."""
    out = np.full(len(x), np.nan)
    if len(x) > n:
        d = np.diff(x)
        up, down = np.maximum(d, 0), np.maximum(-d, 0)
        gain, loss = up[:n].mean(), down[:n].mean()
        for i in range(n, len(x)):
            if i > n:
                gain, loss = (gain * (n - 1) + up[i - 1]) / n, (loss * (n - 1) + down[i - 1]) / n
            out[i] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    return out


class Recursion(NamedTuple):
    """y = decay * y + gain * v over a series v that begins at bar ``first``; its first value is the mean of ``n``."""

    n: int
    first: int
    decay: float
    gain: float

    @property
    def defined(self) -> int:
        return self.first + self.n - 1


def exponential(n: int) -> Recursion:
    return Recursion(n, 0, 1 - 2 / (n + 1), 2 / (n + 1))


def wilder(n: int) -> Recursion:
    return Recursion(n, 1, (n - 1) / n, 1 / n)


def linear_scan(v: np.ndarray, decay: float, gain: float, y: float) -> np.ndarray:
    """y = decay * y + gain * v for each v in turn, a block at a time."""
    out = np.empty(len(v))
    if not len(v):
        return out
    power = decay ** np.arange(BLOCK + 1)
    lags = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    weights = np.where(lags >= 0, power[np.abs(lags)], 0.0) * gain
    for lo in range(0, len(v), BLOCK):
        part = v[lo : lo + BLOCK]
        out[lo : lo + len(part)] = weights[: len(part), : len(part)] @ part + power[1 : len(part) + 1] * y
        y = out[lo + len(part) - 1]
    return out


class Entry(NamedTuple):
    """What a series brings into a range: bars before, the last values, and for each recursion the sum of what its first value is the mean of, and its value."""

    start: int
    tail: np.ndarray
    sums: list[float]
    values: list[float | None]


class Averages:
    """SMAs, EMAs and a strength asked for, over one series or a part of it."""

    def __init__(self, smas: tuple[int, ...], emas: tuple[int, ...], rsi: int | None):
        self.smas, self.emas, self.rsi = smas, emas, rsi
        self.recursions = [exponential(n) for n in emas] + ([wilder(rsi)] * 2 if rsi else [])
        self.halo = max([1, *(n - 1 for n in smas)])
        self.names = [*(f"sma_{n}" for n in smas), *(f"ema_{n}" for n in emas), *([f"rsi_{rsi}"] if rsi else [])]

    def fresh(self) -> Entry:
        return Entry(0, np.empty(0), [0.0] * len(self.recursions), [None] * len(self.recursions))

    def _series(self, x: np.ndarray, tail: np.ndarray) -> list[np.ndarray]:
        step = np.diff(x, prepend=tail[-1] if len(tail) else x[:1])
        return [x] * len(self.emas) + ([np.maximum(step, 0), np.maximum(-step, 0)] if self.rsi else [])

    def exit(self, x: np.ndarray, start: int, tail: np.ndarray) -> list[tuple[float, float, float]]:
        """For each recursion: what the part adds to the sum of its first value, and the map (a, b) of the bars behind that."""
        out = []
        for r, v in zip(self.recursions, self._series(x, tail), strict=True):
            lo, hi = (min(max(k - start, 0), len(v)) for k in (r.first, r.defined + 1))
            rest = v[hi:]
            out.append((float(v[lo:hi].sum()), r.decay ** len(rest), float(linear_scan(rest, r.decay, r.gain, 0.0)[-1]) if len(rest) else 0.0))
        return out

    def advanced(self, e: Entry, size: int, maps: list, tail: np.ndarray) -> Entry:
        """The entry of the range behind one of ``size`` bars."""
        sums = [s + add for s, (add, _, _) in zip(e.sums, maps, strict=True)]
        end, values = e.start + size, []
        for r, s, y, (_, a, b) in zip(self.recursions, sums, e.values, maps, strict=True):
            y = s / r.n if y is None and end > r.defined else y
            values.append(None if y is None else a * y + b)
        return Entry(end, np.concatenate((e.tail, tail))[-self.halo :], sums, values)

    def of(self, x: np.ndarray, e: Entry) -> dict[str, np.ndarray]:
        """The columns asked for; NaN before they are defined."""
        out: dict[str, np.ndarray] = {}
        both = np.concatenate((e.tail, x))
        for n in self.smas:
            column = np.full(len(x), np.nan)
            if len(both) >= n:
                means = np.lib.stride_tricks.sliding_window_view(both, n).mean(1)[-len(x) :]
                column[len(x) - len(means) :] = means
            out[f"sma_{n}"] = column
        found = []
        for r, v, s, y in zip(self.recursions, self._series(x, e.tail), e.sums, e.values, strict=True):
            column = np.full(len(x), np.nan)
            at = r.defined - e.start
            if y is None and at < len(x):
                y = (s + float(v[max(r.first - e.start, 0) : at + 1].sum())) / r.n
                column[at] = y
            if y is not None:
                column[max(at + 1, 0) :] = linear_scan(v[max(at + 1, 0) :], r.decay, r.gain, y)
            found.append(column)
        out.update({f"ema_{n}": c for n, c in zip(self.emas, found, strict=False)})
        if self.rsi:
            up, down = found[-2:]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"rsi_{self.rsi}"] = np.where(np.isnan(down), np.nan, np.where(down <= 0, 100.0, 100 - 100 / (1 + up / down)))
        return out


def _segments(rows: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Where each series begins and ends among rows that are sorted by key."""
    if not len(rows):
        return []
    new = np.zeros(len(rows), bool)
    new[0] = True
    for k in keys:
        c = rows[k]
        new[1:] |= ((c != c.shift()) & ~(c.isna() & c.shift().isna())).to_numpy()[1:]
    begin = np.flatnonzero(new)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(rows)], strict=True))


def _ranges(work: Callable[[int, pd.DataFrame], pd.DataFrame]):
    """Each range as one table: a partition of the checkpoint, or what rows of several there are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in parts:
            for number, own in rows.groupby("__range", sort=False):
                if held and held[0]["__range"].iloc[0] != number:
                    yield work(int(held[0]["__range"].iloc[0]), pd.concat(held, ignore_index=True))
                    held = []
                held.append(own)
        if held:
            yield work(int(held[0]["__range"].iloc[0]), pd.concat(held, ignore_index=True))

    return run


def indicator_set(bars: DataFrame, keys: list[str], order: str, value: str, smas: tuple[int, ...] = (20, 50, 200), emas: tuple[int, ...] = (20, 50, 200), rsi: int | None = 14, range_rows: int = RANGE_ROWS) -> DataFrame:
    """keys, order and value of every bar that has one, its number in the series (from 1), sma_<n>, ema_<n> and rsi_<n> (null before they are defined), and of the series which averages
    its history is too short for (``disabled``) and why. Times of a series are unique."""
    asked = Averages(smas, emas, rsi)
    own = bars.select(*keys, order, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
    own = cut(own)
    n = max(1, -(-own.count() // range_rows))
    held = cut(own.repartitionByRange(n, *keys, order).sortWithinPartitions(*keys, order).withColumn("__range", F.spark_partition_id()))
    ends: list[dict] = []
    if n > 1:  # a range tells its size and keys, and the last values of its last series
        def first_look(number: int, rows: pd.DataFrame) -> pd.DataFrame:
            found = _segments(rows, keys)
            a, b = found[-1]
            return pd.DataFrame([{"number": number, "whole": len(found) == 1, "head": found[0][1], "size": b - a, "tail": rows[value].to_numpy()[max(a, b - asked.halo) : b].tolist()}])

        looked = held.mapInPandas(_ranges(first_look), "number int, whole boolean, head long, size long, tail array<double>").collect()
        edge = held.groupBy("__range").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high")).collect()
        keyed = {r["__range"]: (r["low"], r["high"]) for r in edge}
        ends = sorted(({**r.asDict(), "low": keyed[r["number"]][0], "high": keyed[r["number"]][1]} for r in looked), key=lambda r: r["number"])
        start, tail, before = 0, np.empty(0), None
        for r in ends:
            if before is None or before["high"] != r["low"]:
                start, tail = 0, np.empty(0)
            r["start"], r["guests"] = start, tail
            last = np.array(r["tail"])
            start, tail = (start + r["size"], np.concatenate((tail, last))[-asked.halo :]) if r["whole"] else (r["size"], last)
            before = r
        for k in range(len(ends) - 1, -1, -1):  # how long the first and the last series of each range are in all
            r, after = ends[k], ends[k + 1] if k + 1 < len(ends) else None
            behind = after["first_total"] - after["start"] if after and after["low"] == r["high"] else 0
            r["last_total"] = (r["start"] if r["whole"] else 0) + r["size"] + behind
            r["first_total"] = r["last_total"] if r["whole"] else r["start"] + r["head"]
        entered = {r["number"]: (r["start"], r["guests"]) for r in ends}

        def second_look(number: int, rows: pd.DataFrame) -> pd.DataFrame:
            found = _segments(rows, keys)
            a, b = found[-1]
            start, guests = entered[number] if len(found) == 1 else (0, np.empty(0))
            return pd.DataFrame([{"number": number, "maps": [list(m) for m in asked.exit(rows[value].to_numpy()[a:b], start, guests)]}])

        maps = {r["number"]: r["maps"] for r in held.mapInPandas(_ranges(second_look), "number int, maps array<array<double>>").collect()}
        e, before = asked.fresh(), None
        for r in ends:
            if before is None or before["high"] != r["low"]:
                e = asked.fresh()
            r["entry"] = e
            e = asked.advanced(e if r["whole"] else asked.fresh(), r["size"], maps[r["number"]], np.array(r["tail"]))
            before = r
    known = {r["number"]: (r["entry"], r["first_total"], r["last_total"]) for r in ends}
    too_long = {f"{kind}_{n}": n for kind, ns in (("sma", smas), ("ema", emas)) for n in ns if n >= 200}

    def compute(number: int, rows: pd.DataFrame) -> pd.DataFrame:
        found = _segments(rows, keys)
        x, parts = rows[value].to_numpy(float), []
        for k, (a, b) in enumerate(found):
            entry, first_total, last_total = known.get(number, (None, 0, 0))
            e = entry if entry is not None and k == 0 else asked.fresh()
            total = b - a if entry is None else first_total if k == 0 else last_total if k == len(found) - 1 else b - a
            short = ",".join(c for c, n in too_long.items() if total < n)
            parts.append(pd.DataFrame({"bar": np.arange(e.start + 1, e.start + 1 + b - a), **asked.of(x[a:b], e), "disabled": short or None, "disabled_reason": "insufficient_history" if short else None}))
        made = pd.concat(parts, ignore_index=True)
        made[asked.names] = made[asked.names].astype(object).where(made[asked.names].notna(), None)
        return pd.concat((rows.drop(columns="__range"), made), axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "bar long", *(f"{c} double" for c in asked.names), "disabled string, disabled_reason string"])
    return held.mapInPandas(_ranges(compute), schema)


def latest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key, after whatever was computed over all."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("__r") <= n).drop("__r")


def bars(ticks: DataFrame, keys: list[str], at: str, price: str, every: str, tie: str, begins: str = "0 seconds") -> DataFrame:
    """Open, high, low, close, volume (number) and sum of the ticks of every interval, by partial aggregates; of ticks of one time ``tie`` decides.
    Intervals are counted from ``begins`` after 1970-01-01, a Thursday."""
    first = F.struct(at, tie)
    return (
        ticks.filter(F.col(price).isNotNull())
        .groupBy(*keys, F.window(at, every, startTime=begins).alias("__w"))
        .agg(F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, first).alias("close"), F.count("*").alias("n"), F.sum(price).alias("total"))
        .select(*keys, F.col("__w.start").alias("t"), "open", "high", "low", "close", "n", "total")
    )


def timeframe_bars(ticks: DataFrame, keys: list[str], at: str, price: str, tie: str, frame: str, end: Column, warmup: bool = False) -> DataFrame:
    """The bars of a view (1d, 1w, 1mo, 1yr) up to ``end``: of 5 minutes, hours, days, or weeks from Monday, as far back as the view looks, or with a warm-up
    as its averages need."""
    width, _, back, warm = TIMEFRAMES[frame]
    since = F.unix_micros(end) - int((warm if warmup else back) * 86_400_000_000)
    seen = ticks.filter((F.unix_micros(at) >= since) & (F.col(at) <= end))
    return bars(seen, keys, at, price, width, tie, "4 days" if width == "7 days" else "0 seconds").withColumn("timeframe", F.lit(frame))


def window_return(series: DataFrame, keys: list[str], order: str, opens: str, closes: str) -> DataFrame:
    """Percent from the first open to the last close of each key; null where the open is 0."""
    ends = series.groupBy(*keys).agg(F.min_by(opens, order).alias("first_open"), F.max_by(closes, order).alias("last_close"))
    return ends.withColumn("return_pct", F.when(F.col("first_open") != 0, (F.col("last_close") - F.col("first_open")) / F.col("first_open") * 100))


def change(value: Column, keys: list[str], order: str, lag: int = 1, absolute: bool = True) -> Column:
    """Percent against the value ``lag`` rows before, by its absolute value or itself; null where that is 0 or missing."""
    before = F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(order))
    return F.when(before != 0, (value - before) / (F.abs(before) if absolute else before) * 100)


def price_events(closes: DataFrame, keys: list[str], order: str, close: str, at_least: float = 1.0) -> DataFrame:
    """Keys whose last close moved much in 5 or 21 bars, by max(|5|/3, |21|/5); of equal moves the shorter span is named."""
    moved = closes.withColumn("week", change(F.col(close), keys, order, 5)).withColumn("month", change(F.col(close), keys, order, 21))
    last = latest(moved, keys, order, 1)
    week, month = F.abs("week") / 3, F.abs("month") / 5
    shown = last.withColumn("salience", F.greatest(F.coalesce(week, F.lit(0.0)), F.coalesce(month, F.lit(0.0)))).withColumn("span", F.when(F.coalesce(week, F.lit(0.0)) >= F.coalesce(month, F.lit(0.0)), "1w").otherwise("1mo"))
    return shown.filter(F.col("salience") >= at_least)
