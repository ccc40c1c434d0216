"""A PySpark engine for analysing and maintaining replicated append-only ledgers."""
