"""Layout analysis of documents at corpus scale, on PySpark."""
