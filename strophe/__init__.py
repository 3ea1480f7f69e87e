"""strophe: a Spark-native engine for catalogues of short texts."""
