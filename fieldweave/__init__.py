"""Fieldweave: Spark-native vector layout, neighbour graphs and embedding analytics."""
