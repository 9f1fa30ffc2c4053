"""Building and grading datasets of machine incidents on Spark."""
