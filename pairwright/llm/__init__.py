"""Operators of a training-data pipeline, one module each, and the registered queries on them.

Nothing outside this subpackage imports it.
"""
