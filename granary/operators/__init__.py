"""Operators on keyed DataFrames."""
