"""Spark-first analytics over timed text segments and a canonical corpus."""
