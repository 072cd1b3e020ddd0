"""A Spark-native engine for agent-activity forensics and corpus preparation."""
