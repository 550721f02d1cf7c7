"""Plans of the evaluation-analytics engine."""
