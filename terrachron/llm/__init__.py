"""Corpus-preparation operators for training data.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
