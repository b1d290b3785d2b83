"""Gateway analytics on Spark: keyed sensor tables, a small SQL dialect, device sync and verification."""
