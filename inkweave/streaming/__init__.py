"""Streams of file changes, messages and connections."""
