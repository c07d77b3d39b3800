"""Reading and writing ledger events."""
