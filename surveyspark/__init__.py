"""surveyspark: survey tables to scored, explained predictions, as Spark jobs."""

__version__ = "0.1.0"
