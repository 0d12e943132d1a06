"""All queries outside the training-data part, by name."""

from mailrisk.plans import lookup_queries, queries, stream_queries

QUERIES = {**queries.QUERIES, **lookup_queries.QUERIES, **stream_queries.QUERIES}
