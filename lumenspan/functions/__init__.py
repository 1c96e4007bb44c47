"""Functions of the trace analytics engine."""
