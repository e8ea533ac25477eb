"""Metric points, the keyed metric store and the report cache."""
