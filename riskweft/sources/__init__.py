"""Readers, writers, adapters and the synthetic environment."""
