"""Training-data operators: ten distributed text and vector operators.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``sql.SQL`` hold what the driver entry point registers.
"""
