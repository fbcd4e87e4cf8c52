"""Where graphs come from and go to: text, Parquet, tables."""
