"""millrace: web-content curation on PySpark."""
