"""mossline: retrieval, graph and ranking operators on PySpark DataFrames."""
