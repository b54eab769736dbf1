"""weftgraph: property graphs as three Spark DataFrames, queried by a small pipeline language."""
