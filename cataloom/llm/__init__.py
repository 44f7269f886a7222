"""Operators for preparing training corpora at scale."""
