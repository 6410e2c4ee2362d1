"""Importing this module fills the query registry."""

from queries import q_detections, q_estimators, q_evaluate, q_orders, q_prep, q_retrieval, q_search, q_series, q_sources, q_stats  # noqa: F401
