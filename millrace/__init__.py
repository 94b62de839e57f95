"""Millrace: a PySpark-native analytics library of named DataFrame and SQL queries."""
