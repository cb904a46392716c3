"""Structured Streaming form of the scoring job."""
