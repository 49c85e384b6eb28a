"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries.py`` holds the catalog
entries the driver file adds when the subpackage is present.
"""
