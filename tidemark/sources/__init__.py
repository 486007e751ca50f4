"""Tables to read from and write to: versioned Parquet, JDBC, in memory."""
