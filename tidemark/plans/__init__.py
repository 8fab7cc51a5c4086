"""Whole computations: operators put together, and the queries run on the star-schema tables."""
