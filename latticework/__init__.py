"""A Spark-native analytics engine for atomistic structures, dataset splits and model validation."""
