"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it, so the rest of the library works
with the folder removed.
"""
