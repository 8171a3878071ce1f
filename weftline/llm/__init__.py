"""Training-data operators: one module per operator, ``queries`` registers them.

Nothing outside this subpackage imports it.
"""
