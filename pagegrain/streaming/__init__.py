"""Structured Streaming jobs over box and job tables."""
