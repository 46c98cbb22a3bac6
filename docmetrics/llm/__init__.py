"""Operators of a training-data pipeline: near-duplicate joins, line dedup, vector search, URL and
secret filters, a quality classifier, chat rendering, decontamination, WARC files and packing.

Nothing outside this subpackage imports it (``__spark_entry__.py`` adds its queries when present).
"""
