"""Registered queries by family."""

from lumbre.plans import association_queries, eda_queries, geometry_queries, guard_queries, hidden_positive_queries, metric_queries, model_queries, prepare_queries, result_queries, source_queries, split_queries, subgroup_queries  # noqa: F401
from lumbre.plans.registry import ORACLES, QUERIES  # noqa: F401
