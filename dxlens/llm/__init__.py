"""Corpus operators for training-data pipelines.

Each module holds one operator with its own general interface; ``queries``
registers the thin contract queries over the test tables.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
