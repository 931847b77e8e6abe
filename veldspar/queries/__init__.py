"""Registered queries by family, each with the DuckDB statement it is compared with."""
