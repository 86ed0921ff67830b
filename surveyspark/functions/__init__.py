"""surveyspark.functions."""
