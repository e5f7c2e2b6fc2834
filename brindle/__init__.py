"""Analytics over corpora of text and source code as PySpark DataFrames."""
