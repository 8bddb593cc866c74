"""Structured Streaming ingestion and maintenance."""
