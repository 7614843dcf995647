"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns DataFrames; Python workers see Arrow batches only, never single rows of
a Python UDF.
"""
