"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
