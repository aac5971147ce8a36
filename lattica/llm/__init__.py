"""Training-data operators: each module is one operator, queries.py registers them.

Nothing outside this subpackage, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
