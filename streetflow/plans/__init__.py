"""Finished analyses."""
