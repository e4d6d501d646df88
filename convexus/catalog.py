"""Every query of the library by name, and the DuckDB SQL that says the same."""

from __future__ import annotations

from .plans import audit_queries, coverage_queries, ensemble_queries, fit_queries, report_queries, resample_queries, table_queries, text_queries, traffic_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "residual_p2"
