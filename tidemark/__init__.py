"""Tidemark: market event analytics as composable PySpark DataFrame operators."""
