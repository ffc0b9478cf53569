"""tidegauge operators."""
