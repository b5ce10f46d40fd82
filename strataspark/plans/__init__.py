"""The library's queries over the driver's tables, with the same results as SQL for DuckDB."""
