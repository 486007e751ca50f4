"""Relational operators on DataFrames: keyset paging, watermark windows, merge, reconciliation."""
