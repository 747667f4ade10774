"""Structured Streaming additions (not part of the knowledge-base operators' own surface)."""
