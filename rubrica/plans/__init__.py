"""Whole plans: evaluation runs, and the registered queries over the given tables."""
