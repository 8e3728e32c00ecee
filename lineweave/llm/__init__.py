"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``queries.py`` lists the thin
``opN_<name>`` queries and ``sql.py`` their DuckDB counterparts.
"""
