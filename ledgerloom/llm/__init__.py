"""Training-data operators: tokenizing, filtering, deduplication, redaction, scoring.

Nothing outside this package imports it. Each operator module has a general
interface (DataFrame in, DataFrame out); `registry` holds the queries.
"""
