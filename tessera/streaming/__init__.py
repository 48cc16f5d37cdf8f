"""Incremental counterparts of the batch imports."""
