"""Training-data operators: deduplication, filtering, mixing, tokenising.

Nothing outside this folder imports it; `queries.py` holds the registered
queries and `ORACLE` their SQL.
"""
