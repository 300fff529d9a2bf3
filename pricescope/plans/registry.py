"""All queries of the price-intelligence operators, by name."""

from __future__ import annotations

from pricescope.plans import cases, edges, grid, history, ingest, pricing, report, runs, slices, text

MODULES = [pricing, history, grid, text, ingest, edges, slices, runs, report, cases]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
