"""The retention operators: DataFrame in, DataFrame out."""
