"""Every query of the core by name, and the SQL that must give the same rows."""

from __future__ import annotations

from verdigris.catalog import calibration, conversations, models, policies, ranking, records, texts, universes

_PARTS = (calibration, ranking, conversations, universes, texts, policies, models, records)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
