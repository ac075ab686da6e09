"""Runs that take in only what is new."""
