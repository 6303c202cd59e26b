"""Operators for text corpora that train language models, and their named queries."""
