"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
