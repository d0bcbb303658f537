"""qiyas: Spark-native analytics for short-answer evaluation runs and text corpora."""
