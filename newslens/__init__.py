"""newslens: news-coverage sentiment analytics as PySpark DataFrame jobs."""
