"""DuckDB twins of the registered queries, on the same tables."""
