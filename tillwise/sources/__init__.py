"""Readers, extraction specs, run-committed tables and CSV export."""
