"""Operators for large text corpora: tokenizing, mixing, archiving, deduplication, classification and search."""
