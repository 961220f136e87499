"""Liveness analytics over code-fact tables, written on Spark DataFrames."""
