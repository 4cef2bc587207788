"""Structured Streaming forms of the registry's refresh."""
