"""Operations of a large-scale training-data pipeline.

Each module holds one operator with a general interface; ``queries`` has the
thin per-table queries that derive the digest columns from the operators.
"""
