"""Operators of a training-data pipeline; nothing outside this folder imports them.

One module per operator, ``queries`` registers them, ``corpus_pipeline.py`` at the repository
top chains five of them.  ``tokens`` and ``staging`` hold what several operators share.
"""
