"""DuckDB reference SQL for the correctness check (not used by the engine)."""
