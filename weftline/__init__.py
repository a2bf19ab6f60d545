"""Weftline: log, series, memory, retrieval and graph analytics on Spark DataFrames."""
