"""tracklens: a PySpark-native engine for vessel-track anomaly analytics."""
