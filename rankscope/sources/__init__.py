"""Sources and sinks: parquet tables, CSV with encoding fallback, score registries."""
