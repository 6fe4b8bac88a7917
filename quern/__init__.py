"""quern: artifact analytics and corpus processing on PySpark."""
