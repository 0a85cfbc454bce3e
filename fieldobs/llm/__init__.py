"""Operations of a training-data pipeline: search, de-duplication, scoring, mixing and packing."""
