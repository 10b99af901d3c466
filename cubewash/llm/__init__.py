"""Operators of a large-scale training-data pipeline.

Thirteen operators, one module each, over the tables ``documents``, ``embeddings``,
``benchmark`` and ``labels``. Nothing outside this subpackage imports it.
"""
