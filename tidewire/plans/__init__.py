"""The queries of the engine, entered in the catalogue by the modules here."""

from tidewire.plans import bands, forms, relations, round_trips, series, stories, texts, usage, vectors  # noqa: F401
from tidewire.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
