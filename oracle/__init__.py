"""Plain SQL counterparts of the queries, for another engine to run."""
