"""Operators for preparing training data.

Everything here stands apart from the rest of the library: nothing outside
this subpackage imports it.
"""
