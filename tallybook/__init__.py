"""tallybook: two-ledger token-usage reconciliation as Spark jobs."""
