"""loomgraph: Spark-native analytics over directed transaction multigraphs."""
