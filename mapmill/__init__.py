"""mapmill: gazetteer and old-map analytics, and corpus preparation, as PySpark DataFrame operators."""
