"""Relational, vector, clustering and evaluation operators on DataFrames."""
