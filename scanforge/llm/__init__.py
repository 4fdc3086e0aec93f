"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames;
``catalog`` registers one query for each.
"""
