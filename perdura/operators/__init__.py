"""Joins, aggregates, fitted stages, models and tests on DataFrames."""
