"""Event listings and training-data operators on Spark."""
