"""Training-data pipeline operators.

Each module holds one operator, its query ``opN_<name>`` and, where SQL can
express it, the DuckDB text in ``ORACLE``.  Nothing else in the library
imports this subpackage.
"""
