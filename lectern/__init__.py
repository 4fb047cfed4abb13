"""lectern: Spark-native analytics over assessment data and training corpora."""
