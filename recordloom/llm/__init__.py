"""Operators for training-data pipelines over a `documents` table.

Nothing else in the library imports this subpackage. Every operator takes a frame with the
columns it names, ignores all others, and returns its own columns, so extra columns cannot
clash. `queries` registers one query per operator and holds the SQL twins.
"""
