"""Operations of a training-data pipeline over a ``documents`` table.

Nothing outside this subpackage imports it; ``catalogue`` lists its queries.
"""
