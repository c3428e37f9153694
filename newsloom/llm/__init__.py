"""Operations of a training-data pipeline at scale. Nothing else in the library imports this."""
