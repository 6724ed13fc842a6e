"""Text-vector analytics and corpus preparation on PySpark."""
