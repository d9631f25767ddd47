"""Structured Streaming ingestion of changes."""
