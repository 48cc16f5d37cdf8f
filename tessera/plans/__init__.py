"""Named queries, their SQL counterparts and whole pipelines."""
