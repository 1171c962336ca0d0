"""Operators for training data: cleaning, deduplication, scoring and tokenizing of documents."""
