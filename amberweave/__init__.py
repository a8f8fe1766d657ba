"""A PySpark-native engine for associative document memory."""
