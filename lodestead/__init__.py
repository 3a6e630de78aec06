"""Multi-source listing analytics on PySpark."""
