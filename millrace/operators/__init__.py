"""Relational operators over DataFrames: windows, joins, aggregates, upserts and layouts."""
