"""Registered queries: each applies textlab operators to the given tables
(or stand-ins Spark derives from them) and names a DuckDB oracle."""

from textlab.catalog import experiment, io, labeling, metrics, profile, sampling, spans, streaming, tokens  # noqa: F401
