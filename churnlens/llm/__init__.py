"""Operators of a training-data pipeline (tokens, archives, dedup, quality, language, PII, search).

Nothing else in the library imports this package. Every operator takes a DataFrame and
column names, returns a DataFrame, and states in its docstring what nulls, empty and very
long texts, ties, repeated rows, empty tables and clashing extra columns give.
"""
