"""tidegauge plans."""
