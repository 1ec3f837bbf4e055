"""Where mail tables come from: Parquet folders, SQLite mail files, JSON profiles."""
