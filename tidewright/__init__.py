"""tidewright: a PySpark engine for bid/ask bar series and large text corpora."""
