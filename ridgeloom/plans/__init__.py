"""Named end-to-end queries over the driver's tables, with their DuckDB oracles."""
