"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing outside this folder imports it.  ``registry`` holds the ``opN_`` queries
and their SQL; every other module is one operator with its own interface.
"""
