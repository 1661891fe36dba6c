"""Training-data operators. Nothing else in the library imports this package.

Each module holds one operator with a general interface (real outputs: texts, spans, files) and, at its end, the thin
query that derives the digest columns of the registered ``opN_<name>``.
"""
