"""Operators over lines, clauses, pairs and reports; each takes and returns DataFrames."""
