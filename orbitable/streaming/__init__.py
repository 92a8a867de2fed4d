"""Streaming import of text files: each file is a stateless projection."""
