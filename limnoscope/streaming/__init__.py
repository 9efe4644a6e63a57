"""The sensor feed as a stream."""
