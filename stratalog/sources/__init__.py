"""Sources of ledger data."""
