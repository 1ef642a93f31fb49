"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage; it may import the library's
general helpers.  ``probity.llm.queries`` registers one query per operator.
"""
