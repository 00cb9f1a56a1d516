"""Operations of a training-data pipeline: dedup, search, scans, extraction, mixing, counting."""
