"""Operators for preparing training text: each module holds one operator.

Nothing else in the library imports this subpackage.
"""
