"""A PySpark-native analytics engine: SQL operators as Spark plans."""
