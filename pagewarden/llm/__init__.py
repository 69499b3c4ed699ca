"""Operations of a training-data pipeline: cleaning, deduplication, mixing, tokens.

Nothing else in the library imports this subpackage.
"""
