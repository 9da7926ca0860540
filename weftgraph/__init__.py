"""weftgraph: knowledge-graph translation and analytics as plain Spark DataFrame plans."""
