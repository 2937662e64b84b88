"""Receipts, a hash-chained ledger, verification and folder inventories."""
