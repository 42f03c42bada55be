"""Text-overlap and submission analytics as Spark DataFrame operators."""
