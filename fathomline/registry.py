"""All queries by name, with their SQL."""

from __future__ import annotations

from .operators import batches, cells, containment, corpus, evidence, followup, geometry, grids, grounding, hybrid, layout, lookups, metrics, positions, reports, scalars, signals, tables, texts, vectors, voyages, windows
from .streaming import dialogue, twins, voyage_join

_MODULES = (voyages, texts, vectors, cells, hybrid, evidence, tables, grounding, scalars, corpus, lookups, layout, geometry, grids, containment, batches, followup, positions, signals, metrics, windows, reports, twins, dialogue, voyage_join)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "carbon_rating"
