"""Spark-native analysis of risky outbound e-mail."""
