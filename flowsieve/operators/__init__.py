"""Operators on flow, score, client-update and run-metric tables."""
