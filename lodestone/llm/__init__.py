"""Corpus operators for training-data pipelines.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries.py`` holds the thin ``opN_`` queries over the
``documents`` and ``benchmark`` tables, ``oracles.py`` their SQL.
"""
