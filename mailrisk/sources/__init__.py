"""Readers and writers for raw events, tables, lookups and results."""
