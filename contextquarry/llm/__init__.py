"""Operators that prepare large text corpora for training language models."""
