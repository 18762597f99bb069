"""Readers, canonical documents and publication."""
