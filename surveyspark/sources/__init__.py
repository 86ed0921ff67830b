"""surveyspark.sources."""
