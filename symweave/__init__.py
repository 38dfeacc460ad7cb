"""symweave: code-knowledge-graph analytics and training-data operators on PySpark DataFrames."""
