"""Answers of vendors: JSON of no fixed shape, read as VARIANT and flattened to rows.

What isn't JSON, isn't an object or lacks a part gives no rows of that part, never an error; a field of another type than asked for is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSACTION = {"transaction_date": "string", "transaction_code": "string", "transaction_label": "string", "security_title": "string", "shares": "double", "direction": "string", "price_per_share": "double", "shares_owned_after": "double"}


def field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def insider_transactions(answers: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each transaction of each filing: key, filing and transaction (places in the answer, from 0), filing_date, reporting_person, relationship and the
    transaction's own fields. A filing without transactions is a row of its own; one without a date is left out; a person without a name is ``unknown``."""
    filled = lambda c: F.nullif(c, F.lit(""))
    filings = answers.select(key, F.posexplode(field(F.try_parse_json(text), "filings", "array<variant>")).alias("filing", "f"))
    dated = filings.select(key, "filing", "f", filled(field(F.col("f"), "filing_date", "string")).alias("filing_date")).filter("filing_date IS NOT NULL")
    person = F.coalesce(filled(field(F.col("f"), "reporting_person", "string")), filled(field(F.col("f"), "name", "string")), F.lit("unknown"))
    listed = field(F.col("f"), "transactions", "array<variant>")
    each = dated.select(key, "filing", "filing_date", person.alias("reporting_person"), field(F.col("f"), "relationship", "string").alias("relationship"), (F.coalesce(F.size(listed), F.lit(0)) > 0).alias("listed"), F.posexplode_outer(F.when(F.size(listed) > 0, listed)).alias("transaction", "t"))
    kept = each.filter(~F.col("listed") | _is_object(F.col("t")))
    return kept.select(key, "filing", "transaction", "filing_date", "reporting_person", "relationship", *[field(F.col("t"), c, kind).alias(c) for c, kind in TRANSACTION.items()])


def coverage(answers: DataFrame, key: str, text: str, sections: dict[str, list[str]], aside: str = "as_of") -> DataFrame:
    """key, section and filled: whether a section of the answer has a value in one of its known fields other than ``aside``."""
    doc = F.try_parse_json(text)

    def filled(section: str, fields: list[str]) -> Column:
        own = field(doc, section, "variant")
        said = lambda v: v.isNotNull() & ~F.is_variant_null(v)
        has = [F.coalesce(said(F.try_variant_get(own, f"$.{f}", "variant")), F.lit(False)) for f in fields if f != aside]
        return _is_object(own) & F.coalesce(F.greatest(*has) if len(has) > 1 else has[0], F.lit(False))

    return answers.select(key, F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.coalesce(filled(s, fs), F.lit(False)).alias("filled")) for s, fs in sections.items()])))
