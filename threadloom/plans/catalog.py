"""All core queries with their SQL."""

from __future__ import annotations

from threadloom.plans import control, records, retrieval, texts

_MODULES = (retrieval, records, texts, control)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
