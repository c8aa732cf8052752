"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; it uses the library's general
helpers (session, materialize) only.  One module per operator; ``catalog`` registers one
query per operator, ``oracle`` holds the SQL of those that SQL can express.
"""
