"""Spark-native grounded-answer evaluation, table analytics and corpus operators."""
