"""Page-evidence analytics on PySpark."""
