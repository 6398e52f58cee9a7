"""Editorial-operations analytics expressed as PySpark DataFrame transformations."""
