"""Topic-addressed time-series analytics, expressed as Spark DataFrame plans."""
