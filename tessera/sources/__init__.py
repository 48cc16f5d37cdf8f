"""Readers and writers for corpora, splits, vectors and configurations."""
