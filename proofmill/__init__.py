"""Spark jobs for verified training data and paired model evaluation."""
