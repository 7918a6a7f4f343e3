"""terrane: a Spark-native medallion engine for customer data (Bronze, Silver, Gold)."""

__version__ = "0.1.0"
