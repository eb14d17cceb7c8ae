"""chronofold: a Spark-native engine for time-ordered interaction streams."""
