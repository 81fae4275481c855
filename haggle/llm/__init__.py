"""Operators for corpora of documents: tokens, duplicates, contamination, toxicity, secrets and page text."""
