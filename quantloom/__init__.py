"""Market-panel analytics as Spark jobs: DataFrame in, DataFrame out, over all symbols at once."""
