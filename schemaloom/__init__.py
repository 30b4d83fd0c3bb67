"""Schemaloom: a Spark-native engine for tool-definition catalogs, evaluation analytics and corpus preparation."""
