"""All queries outside the llm subpackage."""

from __future__ import annotations

from tidemark.plans import bars, batches, documents, models, preparation

_MODULES = (preparation, bars, documents, batches, models)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "cum_vwap"
