"""Structured Streaming forms of the pipeline (ST1-ST9)."""
