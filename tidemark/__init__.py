"""Analytics over labelled text corpora and the fleets that annotate them, as Spark DataFrames."""
