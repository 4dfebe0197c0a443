"""quirework: document-evidence analytics on PySpark."""
