"""Entity-performance analytics as PySpark DataFrame operators."""
