"""Tables: Parquet scans and the catalog."""
