"""Relational operators over observations, canonical pairs, candidates, runs and graphs."""
