"""lodestone: a Spark-native hybrid retrieval engine."""
