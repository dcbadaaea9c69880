"""Sources and sinks: the driver's parquet tables, CSV/lab-log readers, writers."""
