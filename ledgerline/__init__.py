"""Ledgerline: a Spark-native analytics engine for business records and governed indicators."""
