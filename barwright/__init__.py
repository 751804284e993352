"""Market-regime analytics on Spark: bars, ticks, fills and regime models as DataFrames."""
