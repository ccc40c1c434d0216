"""Scalar functions of the ledger format as Column expressions."""
