"""Arriving purchase rows matched against a ledger at rest."""
