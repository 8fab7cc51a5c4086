"""Topics and keyed tables as outputs."""
