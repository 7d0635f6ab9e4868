"""Training-data operators: one module each, with their queries in ``queries``.

Nothing outside this subpackage imports it.
"""
