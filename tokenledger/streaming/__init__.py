"""Structured Streaming ingestion and live rollups."""
