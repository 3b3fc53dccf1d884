"""Stallwise: a PySpark-native analytics engine for classified-listing data."""
