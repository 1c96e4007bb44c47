"""Plans of the trace analytics engine."""
