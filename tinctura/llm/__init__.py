"""Operators for training data: copies, overlaps, terms, survivors, look-alikes, answers, packing, leaks and spam.

Nothing outside this package imports it; it may use the core.
"""
