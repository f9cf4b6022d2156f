"""Operators for preparing text corpora: dedup, screening, tokenising, packing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
with the columns of ``documents`` (others are ignored, whatever their names).
"""
