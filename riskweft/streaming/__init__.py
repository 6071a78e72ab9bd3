"""Structured Streaming forms of the time-window operators."""
