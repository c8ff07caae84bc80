"""Readers and writers of place files."""
