"""Readers, workbooks and service providers."""
