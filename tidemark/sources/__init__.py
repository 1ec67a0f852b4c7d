"""Readers and sinks: delimited text, JSON, JSON lines, Excel workbooks, Parquet; names, encodings, gates."""
