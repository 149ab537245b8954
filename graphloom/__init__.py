"""Graph, retrieval, evaluation and training-data operators on PySpark DataFrames."""
