"""The study's plans and the catalogue of queries over the given tables."""
