"""vellum: a Spark-native engine for analysing and converting document corpora."""
