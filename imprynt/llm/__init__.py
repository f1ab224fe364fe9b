"""Operators that prepare training text: one module for each operator.

Every operator takes and returns DataFrames, reads only the columns it names, and states in its
docstring what null, empty, tied and repeated rows give. ``queries`` registers the thin queries.
"""
