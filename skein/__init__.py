"""skein: graph, retrieval and relational analytics on PySpark DataFrames."""
