"""Column -> Column building blocks; no DataFrame, no shuffle, no Python per row."""
