"""brassvane: a Spark-native analytics engine for price bars, reports and news."""

__version__ = "0.1.0"
