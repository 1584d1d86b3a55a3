"""Structured Streaming forms of the index build, the upsert and the politeness timer."""
