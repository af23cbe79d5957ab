"""tessera: code-intelligence and hybrid-retrieval analytics on PySpark DataFrames."""
