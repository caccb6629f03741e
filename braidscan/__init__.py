"""braidscan: similarity, call-graph and evidence-fusion analytics on PySpark."""
