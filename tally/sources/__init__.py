"""Ledger sources."""
