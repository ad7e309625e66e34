"""Structured Streaming forms of floods, incident sessions and episodes."""
