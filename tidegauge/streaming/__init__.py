"""tidegauge streaming."""
