"""DataFrame operators on the document tables."""
