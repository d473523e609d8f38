"""Operators that prepare large-scale language-model training data.

Nothing outside this subpackage imports it.  `registry.queries()` and
`registry.oracle_sql()` list what the driver runs.
"""
