"""Operators on ledger relations: DataFrames in, DataFrames out."""
