"""Spark-native private tree boosting, quantiles and result analytics."""
