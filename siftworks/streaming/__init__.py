"""Structured Streaming forms of the session and click operators."""
