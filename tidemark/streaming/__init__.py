"""The jobs as Structured Streaming queries."""
