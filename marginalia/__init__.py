"""Notes analytics, retrieval and change tracking as PySpark DataFrame jobs."""
