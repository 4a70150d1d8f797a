"""Training-data operators over whole document tables.

Nothing else in the library imports this package; ``queries.py`` registers its
operators and ``__spark_entry__`` adds them when the package is present.
"""
