"""All queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from foliospark.plans import files, layout, paired, runs, texts

MODULES = [runs, paired, layout, texts, files]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
