"""Training-data operators: formatting, filtering, deduplication, mixing and packing.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface, the thin ``opN_*`` query on the driver
tables and, where SQL can express it, the DuckDB statement for the same rows.
"""
