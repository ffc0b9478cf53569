"""tidegauge functions."""
