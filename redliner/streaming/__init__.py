"""Structured Streaming: reports that grow as results arrive."""
