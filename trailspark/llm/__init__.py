"""Operators that prepare training data: ten corpus operators and their registered queries.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
