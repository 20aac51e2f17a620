"""Structured Streaming versions of the stateful operators."""
