"""Operators for preparing training corpora: filters, classifiers, deduplication, tokenisation and mixing."""
