"""Daily demand decomposition as PySpark DataFrame operators."""
