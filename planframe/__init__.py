"""Analytics of structural drawing data as Spark jobs: DataFrames in, DataFrames out."""
