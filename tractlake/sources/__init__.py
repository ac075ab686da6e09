"""Readers of landed files, snapshots and tables."""
