"""Structured Streaming wiring for the stateless preparation operators."""
