"""Spark-native literature screening: papers in, ranked and explained decisions out."""
