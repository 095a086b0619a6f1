"""Operations of a training-data pipeline: mixing, filters, duplicates, extraction and scoring."""
