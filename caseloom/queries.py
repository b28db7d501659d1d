"""All registered queries; importing this module registers them."""

from __future__ import annotations

from caseloom.plans import activity_queries, case_queries, function_queries, graph_queries, lead_queries, record_queries, review_queries, source_queries, stream_queries  # noqa: F401
from caseloom.registry import QUERIES, SQL  # noqa: F401
