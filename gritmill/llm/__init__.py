"""Training-data operators: text classifiers, near-duplicate search, archives, token encoding and mixing.

Nothing outside this subpackage imports it; its queries and SQL are in :mod:`gritmill.llm.queries`.
"""
