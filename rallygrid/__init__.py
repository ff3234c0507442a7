"""rallygrid: a PySpark-native analytics engine for two-sided event data."""
