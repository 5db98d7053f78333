"""Sources and sinks (CSV trait tables, parquet draws store)."""
