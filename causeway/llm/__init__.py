"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  Each operator module has its own
general interface; :mod:`causeway.llm.catalog` holds the thin queries.
"""
