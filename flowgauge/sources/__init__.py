"""Readers for landed raw files and stored tables."""
