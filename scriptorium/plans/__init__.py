"""End-to-end queries over the given tables and their reference SQL."""
