"""Operators of pairloom: each takes and returns DataFrames."""
