"""Structured Streaming form of the folder job."""
