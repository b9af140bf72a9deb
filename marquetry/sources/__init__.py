"""Scans, document parsers and write semantics."""
