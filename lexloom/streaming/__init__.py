"""Structured Streaming forms of ingest and change detection."""
