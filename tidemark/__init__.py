"""tidemark: memory, retrieval and evaluation analytics on the PySpark DataFrame API."""
