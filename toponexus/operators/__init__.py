"""Relational, phrase and assignment operators."""
