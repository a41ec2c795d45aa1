"""Readers of graph text and the Parquet graph store."""
