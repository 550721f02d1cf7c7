"""Operators of the evaluation-analytics engine."""
