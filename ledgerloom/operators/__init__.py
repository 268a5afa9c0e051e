"""Matching, summary, exploration, decision and export operators."""
