"""Readers of raw recipe formats and writers of results."""
