"""Operators that prepare corpora for language-model training.

Nothing outside this package imports it; it can be deleted as a whole.
"""
