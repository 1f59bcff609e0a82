"""A PySpark-native analytics and lineage engine."""
