"""Structured Streaming wiring of the engine."""
