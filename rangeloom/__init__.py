"""rangeloom: ordered-range operators, task graphs and trace analytics on Spark DataFrames."""
