"""Operations of a training-data pipeline, each on DataFrames; nothing else in the library imports them."""
