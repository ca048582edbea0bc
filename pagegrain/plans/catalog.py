"""Imports every query module so that all queries are registered."""

from pagegrain.plans import (  # noqa: F401
    q_boxes,
    q_graph,
    q_jobs,
    q_quality,
    q_review,
    q_sources,
    q_units,
)
from pagegrain.plans.registry import all_oracles, all_queries  # noqa: F401
