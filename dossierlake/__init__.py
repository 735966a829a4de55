"""Document and ledger analytics on Spark."""
