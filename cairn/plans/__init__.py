"""Operators put together into whole requests."""
