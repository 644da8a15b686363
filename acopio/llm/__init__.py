"""Operators for preparing training text at corpus scale.

Nothing else in the package imports this subpackage.  ``registry.QUERIES``
and ``registry.ORACLE_SQL`` hold what ``__spark_entry__`` registers.
"""
