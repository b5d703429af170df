"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it (``corpus_pipeline.py`` counts as part
of it).  Every operator is a ``DataFrame -> DataFrame`` function; ``queries``
holds the thin ``opN_<name>`` queries over the driver's tables.
"""
