"""Readers, writers and adapters from raw dataset shapes to the canonical sample."""
