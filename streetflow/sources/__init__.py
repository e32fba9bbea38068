"""Readers, writers and synthetic tables."""
