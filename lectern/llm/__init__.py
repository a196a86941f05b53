"""Operators for preparing text collections as training data.

Nothing else in the library imports this package; it may be deleted as a whole.
"""
