"""Structured Streaming versions of the run feed and of the fix memory."""
