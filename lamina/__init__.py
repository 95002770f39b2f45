"""Layered analytics for sensitive event records delivered as daily file drops, on Spark."""
