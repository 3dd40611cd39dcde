"""Operators of a training-data pipeline, each a Spark job over whole tables of documents or pages.

Nothing outside this subpackage imports it, so it can be removed without touching the rest.
"""
