"""A PySpark-native engine for company-discovery data."""
