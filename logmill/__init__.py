"""Log analytics on Spark: formats, parsing, classification, metrics and reports."""
