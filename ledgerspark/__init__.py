"""Bank-statement and ledger analytics as PySpark DataFrame jobs."""
