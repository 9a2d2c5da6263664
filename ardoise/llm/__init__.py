"""Operators that prepare text, pages and vectors for training language models."""
