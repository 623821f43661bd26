"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` holds the thin
registered queries over the driver tables.
"""
