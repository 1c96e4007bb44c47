"""Operators of the trace analytics engine."""
