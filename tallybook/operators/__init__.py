"""Batch operators. Every function takes and returns DataFrames and runs nothing by itself
unless its docstring says so."""
