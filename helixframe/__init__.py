"""Spark-native analytics of perturbation experiments."""
