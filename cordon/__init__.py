"""Spark-native ride-marketplace, geofence and demand analytics."""
