"""tidewire: news analytics on PySpark DataFrames."""
