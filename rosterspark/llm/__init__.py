"""Operators for preparing training data: packing, tokenizing, deduplication, scans and archives."""
