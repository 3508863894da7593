"""Annotated-text analytics and training-data preparation on Spark."""
