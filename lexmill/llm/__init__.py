"""Operators for preparing training data: each module holds one operator and its query.

Nothing else in the library imports this subpackage.
"""
