"""Derived test ledgers, registered queries and oracle SQL."""
