"""Operators of a training-data pipeline over the tables ``documents``,
``embeddings`` and ``conversations``.

Nothing outside this subpackage imports it except ``__spark_entry__.py`` and
``corpus_pipeline.py``.
"""
