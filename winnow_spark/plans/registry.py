"""All queries of the package's main part, by name, with their SQL where SQL can say them."""

from __future__ import annotations

from winnow_spark.plans import reduction_queries, report_queries, token_queries

MODULES = (token_queries, reduction_queries, report_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
