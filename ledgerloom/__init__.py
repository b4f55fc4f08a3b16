"""Document retrieval, record analytics and evaluation operators on PySpark."""
