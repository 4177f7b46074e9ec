"""Independent DuckDB SQL for every deterministic query (the correctness oracle)."""
