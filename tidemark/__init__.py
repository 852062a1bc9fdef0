"""Analytics for perpetual-futures funding series, and for large text corpora, on Spark DataFrames."""
