"""Bulk-synchronous graph analytics on Spark DataFrames."""
