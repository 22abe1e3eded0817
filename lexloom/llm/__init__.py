"""Operators for training-data pipelines at corpus scale.

Nothing else in the library imports this subpackage.  Each operator has its own
module with a general interface; :mod:`lexloom.llm.registry` holds the thin
queries and their SQL.
"""
