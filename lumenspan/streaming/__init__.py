"""Streaming of the trace analytics engine."""
