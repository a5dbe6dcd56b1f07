"""Readers, writers and the bindings of logical tables to Parquet tables."""
