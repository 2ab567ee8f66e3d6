"""Relational operators with the dialect's semantics, as compositions of DataFrame operations."""
