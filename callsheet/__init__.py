"""Phone campaign lists for debt collection, as PySpark DataFrame functions."""
