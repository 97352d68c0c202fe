"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries if it is there.
"""
