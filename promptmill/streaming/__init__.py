"""Structured Streaming forms of the pipeline steps."""
