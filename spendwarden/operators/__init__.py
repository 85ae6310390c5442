"""Distributed operators Spark does not ship: fuzzy join, connected components, keyed upserts, resolution."""
