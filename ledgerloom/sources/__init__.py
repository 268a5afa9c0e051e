"""Readers and ledger builders."""
