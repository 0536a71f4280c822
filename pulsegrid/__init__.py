"""Activity analytics for open-source communities as Spark DataFrame operators."""
