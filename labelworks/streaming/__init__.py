"""Structured Streaming forms of labeling, progress, corrections and usage."""
