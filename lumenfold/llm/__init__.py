"""Operations of a large-scale training-data pipeline, one module for each.

Nothing outside this subpackage imports it. ``registry`` holds the queries that
``__spark_entry__`` registers.
"""
