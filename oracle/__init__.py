"""DuckDB oracle SQL for the driver's correctness check."""
