"""Structured Streaming forms of the operators.

Everything per line (``plans.pipeline.enrich``) runs on a stream as it is.
"""
