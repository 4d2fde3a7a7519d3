"""Operators that prepare a corpus of documents and pages for training language models."""
