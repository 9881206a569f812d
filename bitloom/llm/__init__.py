"""Operators of a training-data pipeline: mixing, packing, quality, privacy, near-duplicates, archives and search.

Nothing outside this folder imports it.  ``bitloom.llm.registry`` lists the queries.
"""
