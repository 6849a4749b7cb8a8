"""Data-quality audits and training-data operators on Spark."""
