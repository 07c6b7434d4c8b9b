"""Training-data operators: scoring, de-duplication, decontamination, mixing, output.

Nothing else in the library imports this subpackage. Every module is one
operator with a general interface; ``queries.py`` holds the thin registered
queries and ``sql.py`` their DuckDB statements.
"""
