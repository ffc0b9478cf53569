"""tidegauge sources."""
