"""tidegauge - early-warning analytics for a maritime chokepoint, on Spark DataFrames."""
