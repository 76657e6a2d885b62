"""Operations of a training-data pipeline: each is a function from DataFrames to a DataFrame."""
