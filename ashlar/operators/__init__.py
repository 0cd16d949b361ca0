"""Operators on graph tables; each takes and returns DataFrames."""
