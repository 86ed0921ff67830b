"""surveyspark.operators."""
