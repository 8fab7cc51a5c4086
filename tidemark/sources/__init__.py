"""Topics, keyed tables, and inputs derived from the star-schema tables."""
