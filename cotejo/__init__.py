"""Spark-native comparison of student programs: coverage, generation tasks, similarity, style and reports."""
