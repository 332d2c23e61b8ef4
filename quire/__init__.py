"""quire: a Spark-first engine for analysing large document collections."""
