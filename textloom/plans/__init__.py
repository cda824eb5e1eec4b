"""Registered queries: each has a DataFrame form and, where SQL can say it, SQL for DuckDB."""
