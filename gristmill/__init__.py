"""Spark-native data catalog, SQL federation, preparation, modelling and run-log analytics."""
