"""Structured Streaming forms of the record pipeline."""
