"""Dependency graphs and execution ledgers as Spark tables.

Every operator takes DataFrames and returns DataFrames; see README.md for the index.
"""
