"""All registered queries of the library."""

from ..registry import ORACLES, QUERIES
from . import curve_queries, descriptor_queries, guard_queries, model_queries, norm_queries, quality_queries, relational_queries, scalar_queries, signal_queries, text_queries

__all__ = ["ORACLES", "QUERIES", "curve_queries", "descriptor_queries", "guard_queries", "model_queries", "norm_queries", "quality_queries", "relational_queries", "scalar_queries", "signal_queries", "text_queries"]
