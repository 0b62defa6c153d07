"""Structured Streaming jobs of the daily feed."""
