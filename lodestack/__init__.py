"""Evidence retrieval over large document collections, on PySpark DataFrames."""
