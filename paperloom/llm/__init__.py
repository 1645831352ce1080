"""Training-data operators: tokens, duplicates, language, toxicity, quality, sharding and mixing.

Nothing outside this subpackage imports it.
"""
