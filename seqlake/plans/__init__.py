"""Composite plans: derived sample tables, cleaning, training, inference, and
the registry of named queries with their DuckDB oracle SQL."""
