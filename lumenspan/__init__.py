"""lumenspan: a Spark-native analytics engine for timed transcripts."""
