"""Operators for preparing training text: filters, deduplication, scans and encoding."""
