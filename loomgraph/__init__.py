"""loomgraph: a Spark-native analytics engine for learning data over prerequisite graphs."""

__version__ = "0.1.0"
