"""Training-data operators: ten corpus stages on Spark, independent of the graph engine."""
