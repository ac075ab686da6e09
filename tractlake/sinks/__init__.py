"""Writers of tables, snapshots and run metrics."""
