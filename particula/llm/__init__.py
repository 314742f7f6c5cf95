"""Operators for preparing language-model training data.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Every
operator module holds a general function on DataFrames; ``queries`` holds the
thin registered queries ``opN_<name>`` and their SQL.
"""
