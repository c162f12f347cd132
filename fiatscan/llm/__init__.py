"""Operations of a training-data pipeline: sharding, filtering, deduplication, encoding and search."""
