"""A PySpark-native batch key/value dataflow engine."""
