"""Whole plans: the annotate facade, global ranking, and the registry of queries."""
