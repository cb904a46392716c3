"""Readers for raw logs and records, writers for results."""
