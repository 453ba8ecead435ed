"""Spark-native analytics for purchasing, stock, till and bank ledgers."""
