"""Posting analytics on Spark: every stage takes DataFrames and returns DataFrames."""
