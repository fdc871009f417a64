"""Operations of a training-data pipeline: similarity joins, scoring, search, clean-up, tokens, packing."""
