"""ringloom: a Spark-native engine for circular-transcript analytics."""
