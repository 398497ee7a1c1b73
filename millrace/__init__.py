"""millrace: a Spark-native analytics engine expressed as DataFrame and SQL plans."""
