"""Operators over archive tables: DataFrames in, one lazy DataFrame out."""
