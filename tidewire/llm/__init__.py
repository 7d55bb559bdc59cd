"""Operators for large training corpora; their queries are in :mod:`tidewire.llm.registry`."""
