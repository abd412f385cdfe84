"""Spark-native web-shop warehouse: staging, star schema loads and sales reports."""
