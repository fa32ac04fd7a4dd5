"""Named queries over the provided tables, each with DuckDB SQL."""
