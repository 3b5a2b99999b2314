"""Document analytics on Spark: from pages of lines to clean, citable, measured text."""
