"""Operators of a training-data pipeline (archives, chat, search, cleaning, tokens).

Nothing else in the package imports this subpackage.  Every operator takes
DataFrames and plain parameters and returns DataFrames; the ``opN_*`` queries
in ``registry`` are thin calls with production parameters.
"""
