"""Operators for preparing training data at corpus scale.

Nothing else in the package imports this subpackage; queries and their SQL are
in :mod:`quern.llm.queries`.
"""
