"""All registered queries."""

from phenospark.catalog.base import ORACLES, QUERIES
from phenospark.catalog import (q_aggregates, q_curation, q_evaluate, q_features, q_functions, q_joins, q_projections,
                                q_results, q_retrieval, q_sources, q_stats, q_whitening, q_windows)

__all__ = ["ORACLES", "QUERIES"]
