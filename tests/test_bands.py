"""Small rules by their cases: bands at their edges, short forms, numbers of texts, windows of kinds, weeks, sentences."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import text, values
from tidewire.operators import indicators, scoring


def column(spark, rows, schema, *made):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*made).collect()]


def test_short_forms_have_their_sign_before_the_unit(spark):
    cases = [(2_239_000_000.0, "$2.24B", "2.24B"), (15_400_000.0, "$15.40M", "15.40M"), (-1_200_000_000.0, "-$1.20B", "-1.20B"), (3.1, "$3.10", "3.10"), (1250.0, "$1.2K", "1.2K"), (0.0, "$0.00", "0.00"), (None, None, None), (float("nan"), None, None), (float("-inf"), None, None)]
    assert column(spark, [(v,) for v, _, _ in cases], "v double", text.usd_short(F.col("v")), text.count_short(F.col("v"))) == [c[1:] for c in cases]


def test_numbers_of_texts(spark):
    cases = [(" 12\n", 12.0, 12, 12), ("1e3", 1000.0, None, 1), ("12f", None, None, 12), ("1d", None, None, 1), ("-.5", -0.5, None, 5), ("-Infinity", float("-inf"), None, None), ("", None, None, None), (None, None, None, None), ("↑ 1,079", None, None, 1079), ("99999999999999999999", 1e20, None, None)]
    assert column(spark, [(t,) for t, *_ in cases], "t string", values.float_or_null(F.col("t")), values.int_or_null(F.col("t")), values.first_int(F.col("t"))) == [tuple(c[1:]) for c in cases]


def test_bands_at_their_edges(spark):
    cases = [(75, 72, "active", "high", "strengthening"), (74, 77, "active", "medium", "weakening"), (59, 57, "active", "low", "stable"), (None, 50, "active", "medium", "stable"), (80, None, None, "high", "stable"), (90, 10, "stressed", "high", "stressed")]
    assert column(spark, [c[:3] for c in cases], "s int, p int, st string", scoring.signal_of(F.col("s")), scoring.trend_of(F.col("s"), F.col("p"), F.col("st"))) == [c[3:] for c in cases]
    advice = [(34, "active", None, "Review or restate."), (35, "active", "stresses", "Watch. One invalidation is trending."), (35, None, None, "Watch."), (70, "active", "stresses", "Holding, but one signal is challenging."), (70, "active", "supports", "Holding. Let it run."), (90, "stressed", None, "Review or restate."), (90, "resolved", None, None), (None, "active", None, "Review or restate.")]
    assert column(spark, [c[:3] for c in advice], "s int, st string, r string", scoring.prescription(F.col("s"), F.col("st"), F.col("r"))) == [c[3:] for c in advice]
    assert column(spark, [("supports", 0.7), ("stresses", 0.71), ("supports", 0.69), ("unrelated", 0.9), (None, None)], "r string, c double", scoring.chip(F.col("r"), F.col("c"))) == [("Supports",), ("Stresses",), (None,), (None,), (None,)]


def test_windows_of_kinds(spark):
    cases = [("story", 72.0, None, True), ("story", 72.1, None, False), ("story", 1.0, "unclear", False), ("story", 1.0, "good", True), ("x", 48.0, "unclear", True), ("x", 48.1, None, False), (None, 60.0, None, True), ("other", 1.0, None, False), ("x", None, None, False)]
    assert column(spark, [c[:3] for c in cases], "k string, a double, l string", scoring.in_feed(F.col("k"), F.col("a"), F.col("l"))) == [c[3:] for c in cases]


def test_sentences_colours_and_taxonomy(spark):
    rows = [('One. Two! "Three?" 4. five. Six',), ("",), ("no end",), (None,)]
    assert column(spark, rows, "t string", text.sentences(F.col("t"))) == [(["One.", "Two!", '"Three?" 4. five.', "Six"],), ([""],), (["no end"],), (None,)]
    assert column(spark, [("ab",), ("",), ("é",)], "t string", text.colour(F.col("t"), ["a", "b", "c"])) == [("abc"[(97 + 98) % 3],), ("a",), ("abc"[233 % 3],)]
    aliases = F.create_map(F.lit("oil_gas"), F.array(F.lit("e.oil")), F.lit("travel & x"), F.array(F.lit("c.t"), F.lit("e.oil")))
    labels = [(["Travel & X", " Oil Gas "],), ([None, "?"],), ([],)]
    assert column(spark, labels, "l array<string>", text.normal_label_list(F.col("l"), aliases, F.array(F.lit("e.oil"), F.lit("c.t")))) == [(["c.t", "e.oil"],), ([],), ([],)]
    assert column(spark, [("“It’s”  ﬁne… STRASSE",), (None,)], "t string", text.quote_form(F.col("t"))) == [('"it\'s" fine... strasse',), (None,)]


def test_weeks_begin_on_monday_and_views_look_back(spark):
    end = dt.datetime(2024, 3, 15, 12)
    ticks = spark.createDataFrame([(k, "s", end - dt.timedelta(days=d), float(d)) for k, d in enumerate([0, 4, 5, 6, 11, 13, 40, 500])], "i long, s string, at timestamp, v double")
    found = {f: [(r.t, r.n) for r in indicators.timeframe_bars(ticks, ["s"], "at", "v", "i", f, F.lit(end)).orderBy("t").collect()] for f in ("1d", "1yr")}
    assert sum(n for _, n in found["1d"]) == 3 and sum(n for _, n in found["1yr"]) == 7
    assert all(t.weekday() == 0 and t.hour == 0 for t, _ in found["1yr"])
    assert indicators.timeframe_bars(ticks, ["s"], "at", "v", "i", "1yr", F.lit(end), True).agg(F.sum("n")).first()[0] == 8
