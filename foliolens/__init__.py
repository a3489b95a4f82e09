"""Document-quality analytics over tables of many documents, built on Spark DataFrames."""
