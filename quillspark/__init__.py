"""A Spark-first engine for analysing, searching and curating document corpora."""
