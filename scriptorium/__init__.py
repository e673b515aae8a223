"""Pen strokes and page structure on Spark: DataFrame in, DataFrame out."""
