"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it, but for the guarded import in ``__spark_entry__.py``.
"""
