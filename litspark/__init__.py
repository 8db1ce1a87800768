"""litspark: literature-collection analytics as PySpark DataFrame transformations."""
