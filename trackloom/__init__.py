"""trackloom: a Spark-native engine for analytics over moving-object position reports."""
