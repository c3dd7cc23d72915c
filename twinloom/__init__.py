"""A PySpark-native near-duplicate and entity-resolution engine."""
