"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import exact_topk, html_text, jaccard_join, language_id, packing, periodic_runs, quality_rules, secret_scan, source_mixing, spelling_variants, spot_signatures, substring_dedup, token_file

MODULES = [exact_topk, html_text, jaccard_join, language_id, packing, quality_rules, secret_scan, source_mixing, substring_dedup, token_file, spelling_variants, periodic_runs, spot_signatures]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
