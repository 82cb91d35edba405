"""Evaluation analytics on Spark: design, validate, grade, score and audit model replies."""
