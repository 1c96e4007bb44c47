"""Sources of the trace analytics engine."""
